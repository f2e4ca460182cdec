"""Rules: held-out accuracy, compiled columns against plain Python, the lasso's optimality, edge cases."""

import numpy as np
import pytest
from lineupkit.llm import quality_rules as qr
from lineupkit.llm.language_id import held_out
from lineupkit.runtime import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return qr.fit(docs.where(~held_out()), labels)


def test_held_out_accuracy(spark, model):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = qr.score(docs.where(held_out()).select("doc_id", "text"), model).join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1], rows.score[rows.quality == 0]
    auc = np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad])
    assert auc > 0.97 and (rows.predicted == rows.quality).mean() > 0.95
    assert 0 < len(model.rules) < 250 and all(1 <= len(r) <= 3 for r in model.rules) and len(model.describe()) == len(model.rules)


def test_compiled_score_equals_rules(spark, model):
    rows = table(spark, SF, "documents").limit(200).select(qr.statistics(F.col("text")).alias("s")).select("s.*", model.score("s").alias("z")).toPandas()
    x = rows[qr.STATISTICS].to_numpy()
    z = model.intercept + sum(w * qr._holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    assert np.abs(rows.z - 1 / (1 + np.exp(-z))).max() < 1e-12


def test_statistics(spark):
    texts = ["Aa bb bb. C1!\nÄÖ #x\nÄÖ #x", "", None, " \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(qr.statistics(F.col("text")).alias("s")).select("s.*").collect()
    first = rows[0].asDict()
    want = {"chars": 25, "words": 8, "lines": 3, "longest_word": 3, "letters": 13 / 25, "upper": 6 / 13, "digits": 1 / 25, "symbols": 2 / 25, "marks": 2 / 25, "repeats": 0, "distinct_words": 6 / 8, "distinct_lines": 2 / 3, "ends": 2 / 8, "shouts": 1 / 8, "capital_words": 2 / 8, "bytes_a_char": 29 / 25}
    assert {k: first[k] for k in want} == pytest.approx(want)
    assert tuple(rows[1]) == tuple(rows[2]) and rows[3].words == 0


def test_lasso_is_optimal():
    rng = np.random.default_rng(1)
    x = (rng.random((500, 12)) < 0.4).astype(np.float32)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    w, b = qr.lasso(x, y, 0.03, 3000)
    g = ((x - x.mean(0)) / x.std(0)).T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / 500
    assert np.abs(g[w != 0] + 0.03 * np.sign(w[w != 0])).max() < 1e-3 and np.abs(g[w == 0]).max() < 0.03 + 1e-3
    assert w[0] > 0 > w[1] and (w == 0).sum() >= 6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "q"), (1, "", "q"), (None, "x" * 300_000, None)], "doc_id long, text string, score string")
    for model in (qr.RuleEnsemble([], [], 0.0), qr.RuleEnsemble([((0, True, 10.0),)], [3.0], -1.0)):
        rows = qr.score(docs.withColumnRenamed("score", "s_"), model).collect()
        assert len(rows) == 3 and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.fit(docs, none).intercept == 0 and qr.score(docs.limit(0), qr.fit(docs.limit(0), none)).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "d"), (2, "c"), (None, "e")], "doc_id long, text string")
    one = qr.fit(few, spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 1), (4, None), (None, 0), (9, 0)], none.schema))
    assert one.rules == [] and one.intercept > 0
