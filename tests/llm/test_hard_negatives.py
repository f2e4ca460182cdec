"""Hard negatives against brute force: regions, ties, copies, odd rows and lists in many parts."""

import math

import numpy as np
import pytest
from lineupkit.llm import hard_negatives as hn
from lineupkit.llm import queries
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=10, positives=5, negatives=3):
    """Every anchor and positive with its first negatives; rows alike count once."""
    known = {}
    for vec, e, label in rows:
        if vec is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        known[vec, label, tuple(math.floor(256 * x) for x in e)] = None
    known, out = sorted(known, key=lambda k: k[:2]), []
    for a in known:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=True))  # noqa: B023, E731
        others = sorted(((-score(b), b[0], b[1]) for b in known if b != a and len(b[2]) == len(a[2])))
        for p, vec, _ in [o for o in others if o[2] == a[1]][:positives]:
            fit = [(n, v) for n, v, label in others if label != a[1] and -50 * p <= -100 * n <= -95 * p][:negatives]
            out += [(a[0], vec, k + 1, v, -p, -n) for k, (n, v) in enumerate(fit)]
    return sorted(out)


def regions(n, d=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    own = rng.integers(0, 9, n)
    x = centres[own] + 0.4 * rng.normal(size=(n, d))
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.where(rng.random(n) < 0.4, 1, rng.integers(0, 6, n))  # one label holds a third and more
    return [(k, [float(v) for v in x[k]], int(label[k])) for k in range(n)]


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS list", "1 AS id")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


@pytest.mark.parametrize("more", [{}, {"list_rows": 7, "max_lists": 5, "seeds": 1, "sample_rows": 60}])
def test_equals_brute_force(spark, more):
    rows = regions(400)
    same = rows[17][1]
    rows += [(1000 + k, same, k % 3) for k in range(60)]  # one vector often: ties, and a hot list
    rows += rows[:20]  # rows alike
    rows += [(2000 + k, [0.5 - k / 9, 0.25], k % 2) for k in range(12)]  # of another length
    rows += [(3000, [0.0] * 12, 1), (3001, None, 1), (3002, [None] * 12, 1), (3003, [float("nan")] * 12, 2), (3004, [float("inf")] * 12, 2)]
    rows += [(3010, [0.1] * 12, None), (None, [0.1] * 12, 1), (3020, [0.3] * 12, 99), (3030, [], 1), (3031, [], 2)]
    assert found(spark, rows, **more) == plain(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(10, [0.5], 1)]) == []


def test_exact_products():
    a = np.array([[2.0**40, 3.0]])
    assert hn.products(a, np.array([[2.0**20, 5.0]]))[0, 0] == 2**60 + 15


def test_radii_hold_all_rows():
    x = np.random.default_rng(4).normal(size=(500, 6)) * 40
    lists = hn.Lists({6: hn.k_means(x[:100], 8)})
    own = hn.nearest_centre(x, lists.centres[6])
    far = np.sqrt(((x - lists.centres[6][own]) ** 2).sum(1))
    lists.deal({k: (int((own == k).sum()), float(far[own == k].max())) for k in range(8) if (own == k).any()}, 50, 4)
    top, low = lists.bounds(6, x[:40])
    scores = x[:40] @ x.T
    assert (scores <= top[:, own]).all() and (scores >= low[:, own]).all() and lists.parts.max() > 1


def test_query_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(duck.execute(queries.SQL["op13_hard_negatives"]).fetchall())
