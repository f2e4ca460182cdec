"""Operator 12: quality classifier by a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark columns.  On a bounded sample of labelled texts, boosted shallow trees are grown in numpy; every
path from a root is a rule, a conjunction of comparisons; a logistic regression with a lasso penalty weighs the rules and
leaves few; those are compiled into one Spark column, so scoring is one pass without Python.

The sample: at most about ``max_rows`` distinct labelled texts, those with the smallest hashes (a share computed from the full count).

Nulls and edge cases: a null text is scored as an empty one; labels that are null, or whose doc_id is null or unknown, are
not learned from; several labels of one text are averaged; a document's label rows never enter its score; without a
labelled row every score is 0.5, with labels of one kind only all scores lean to it alike; repeated doc_ids are rows like
others, an empty table gives no rows, other columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm.language_id import held_out
from lineupkit.runtime import stash, table

#: Names of the statistics, in the order of ``statistics``.
STATISTICS = [
    "chars", "words", "lines", "word_length", "line_length", "longest_word", "bytes_a_char", "letters", "upper", "digits", "symbols",
    "marks", "shouts", "ends", "distinct_words", "repeats", "distinct_lines", "capital_words",
]
_BLANK = r"[ \t-\r]+"


def statistics(text: Column) -> Column:
    """A struct of doubles, all of the whole text; shares are 0 where there is nothing to share."""
    t = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        size = F.length(t)
        gone = lambda pattern: size - F.length(F.regexp_replace(t, pattern, ""))
        # Split once: the words and lines are bound to lambdas' variables.
        words = F.filter(F.split(t, _BLANK), lambda w: w != "")
        of_words = F.transform(
            F.array(words),
            lambda w: F.struct(
                F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest"),
                F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0)))))).alias("repeats"),
            ),
        )
        of_lines = F.transform(F.array(F.split(t, "\n")), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
        w, x = F.get(of_words, F.lit(0)), F.get(of_lines, F.lit(0))
        return F.struct(
            size.alias("chars"), w.alias("w"), x.alias("x"), F.octet_length(t).alias("bytes"), gone(r"\p{L}+").alias("letters"), gone(r"\p{Lu}+").alias("upper"),
            gone(r"\d+").alias("digits"), gone(r"[#$%&*+/<=>@\\^_`{|}~\[\]]+").alias("symbols"), gone(r"[,;:.!?'\"()-]+").alias("marks"), gone("[!?]+").alias("shouts"),
            F.regexp_count(t, F.lit(r"[.!?]+")).alias("ends"), F.regexp_count(t, F.lit(r"\p{Lu}{2,}")).alias("capital"),
        )

    def shares(s: Column) -> Column:
        n, chars = s["w"]["n"], s["chars"]
        over = lambda a, b: a / F.greatest(b, F.lit(1)).cast("double")
        values = [
            chars, n, s["x"]["n"], over(chars, n), over(chars, s["x"]["n"]), s["w"]["longest"], over(s["bytes"], chars), over(s["letters"], chars),
            over(s["upper"], s["letters"]), over(s["digits"], chars), over(s["symbols"], chars), over(s["marks"], chars), over(s["shouts"], n), over(s["ends"], n),
            over(s["w"]["distinct"], n), over(s["w"]["repeats"], n), over(s["x"]["distinct"], s["x"]["n"]), over(s["capital"], n),
        ]
        return F.struct(*[v.cast("double").alias(k) for k, v in zip(STATISTICS, values, strict=True)])

    return F.get(F.transform(F.transform(F.array(t), of), shares), F.lit(0))


#: A condition: statistic, whether it must be above, threshold.
Condition = tuple[int, bool, float]


@dataclass
class RuleEnsemble:
    """Rules with their weights, and the intercept of the logistic score."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self, stats: str) -> Column:
        """The score as a column of a struct column named ``stats``."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, cut in rule:
                value = F.col(f"{stats}.{STATISTICS[k]}")
                holds = holds & ((value > cut) if above else (value <= cut))
            z = z + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def describe(self) -> list[str]:
        """The rules in words, the heaviest first."""
        text = [" and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {cut:.6g}" for k, above, cut in rule) for rule in self.rules]
        return [f"{w:+.4f} {t}" for w, t in sorted(zip(self.weights, text, strict=True), key=lambda x: -abs(x[0]))]


def _binned(x: np.ndarray, bins: int = 32) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers and cuts of each statistic: a value is in bin k if it lies above k cuts."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]), cuts


def _paths(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, some: np.ndarray, depth: int, least: int) -> tuple[list, list]:
    """All paths of a least-squares tree, and those that end in a leaf."""
    paths, leaves = [], []

    def grow(rows: np.ndarray, path: tuple[Condition, ...], left: int) -> None:
        best, total, n = None, target[rows].sum(), len(rows)
        for k in some if left and n >= 2 * least else ():
            size = len(cuts[k]) + 1
            count = np.cumsum(np.bincount(binned[rows, k], minlength=size))[:-1]
            sums = np.cumsum(np.bincount(binned[rows, k], target[rows], size))[:-1]
            fit = (count >= least) & (n - count >= least)
            if fit.any():
                gain = np.where(fit, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1), -np.inf)
                at = int(gain.argmax())
                if best is None or gain[at] > best[0] + 1e-12:
                    best = gain[at], k, at
        if best is None or best[0] <= total**2 / n + 1e-9:
            leaves.append(path)
            return
        _, k, at = best
        for above in (False, True):
            then = (*path, (int(k), above, float(cuts[k][at])))
            paths.append(then)
            grow(rows[(binned[rows, k] > at) == above], then, left - 1)

    grow(rows, (), depth)
    return paths, leaves


def _simple(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One condition a statistic and side: the narrower."""
    kept: dict[tuple[int, bool], float] = {}
    for k, above, cut in rule:
        old = kept.get((k, above), cut)
        kept[k, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((k, above, cut) for (k, above), cut in kept.items()))


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def lasso(design: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on standardised columns, the intercept free: accelerated proximal gradient."""
    n, mean, dev = len(y), design.mean(0), np.maximum(design.std(0), 1e-9)
    x = ((design - mean) / dev).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    v = np.ones(x.shape[1], np.float32)  # a bound of the curvature by power iteration
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.sqrt(v @ v), 1e-12)
    step = 1 / (0.25 * max(float(v @ (x.T @ (x @ v))) / n, 1.0) * 1.05)
    u, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 0.5 * (1 + np.tanh((x @ u.astype(np.float32) + c) / 2)) - y
        g = u - step * (x.T @ r.astype(np.float32)) / n
        new, bias = np.sign(g) * np.maximum(np.abs(g) - step * penalty, 0), c - step * r.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / after * (new - w), bias + (t - 1) / after * (bias - b)
        w, b, t = new, bias, after
    w = w / dev
    return w, float(b - w @ mean)


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 0.002, seed: int = 12) -> RuleEnsemble:
    """Rules of boosted trees, each on half of the rows and half of the statistics, weighed by the lasso."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    if y.min() == y.max():
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    binned, cuts = _binned(x)
    z, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        residual = y - 0.5 * (1 + np.tanh(z / 2))
        rows = rng.permutation(len(y))[: max(1, len(y) // 2)]
        some = np.sort(rng.permutation(x.shape[1])[: x.shape[1] // 2])
        paths, leaves = _paths(binned, cuts, residual, rows, some, depth, max(5, len(y) // 500))
        for rule in paths:
            rules.setdefault(_simple(rule))
        # The step of boosting: each leaf's residual over its curvature, on all rows.
        leaf = np.zeros(len(y))
        for p in leaves:
            held = _holds(p, x)
            q = 0.5 * (1 + np.tanh(z[held] / 2))
            leaf[held] = residual[held].sum() / max((q * (1 - q)).sum(), 1e-3)
        z += rate * np.clip(leaf, -4, 4)
    names = list(rules)
    if not names:
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    # Of rules that hold for the same rows, or for exactly the others, the first.
    columns: dict[bytes, tuple[tuple[Condition, ...], np.ndarray]] = {}
    for rule in names:
        held = _holds(rule, x)
        if 0 < held.sum() < len(held):
            columns.setdefault((held if held[0] else ~held).tobytes(), (rule, held))
    names = [rule for rule, _ in columns.values()]
    weights, intercept = lasso(np.column_stack([held for _, held in columns.values()]).astype(np.float32), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    return RuleEnsemble([names[k] for k in kept], [float(weights[k]) for k in kept], intercept)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, seed: int = 12) -> RuleEnsemble:
    """Learn from (doc_id, text) and (doc_id, quality): distinct labelled texts, about ``max_rows`` at most.

    Only hashes and labels are shuffled; the texts of the sample are found where they lie, by its hashes.
    """
    hashed = docs.select("doc_id", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("hash_"))
    known = hashed.join(labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    known = stash(known.groupBy("hash_").agg(F.avg("y").alias("y"), F.min("doc_id").alias("id_")), "labelled")
    count, span = known.count(), 1 << 40
    if not count:
        return RuleEnsemble([], [], 0.0)
    few = known.where(F.pmod("hash_", F.lit(span)) < F.lit(-(-span * min(max_rows, count) // count)))
    # About max_rows rows of three numbers: a proven bound for the broadcast.
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("hash_")).join(F.broadcast(few), "hash_").where("doc_id = id_")
    sample = rows.select("hash_", "y", statistics(F.col("text")).alias("s")).dropDuplicates(["hash_"]).select("hash_", "y", "s.*").toArrow().sort_by("hash_")
    if not sample.num_rows:
        return RuleEnsemble([], [], 0.0)
    x = np.column_stack([sample.column(c).to_numpy() for c in STATISTICS])
    return train(x, (sample.column("y").to_numpy() >= 0.5).astype(float))


def score(docs: DataFrame, rules: RuleEnsemble) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added, from ``text`` alone."""
    names = [f"c{k}_" for k in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    with_stats = docs.toDF(*names).withColumn("s_", statistics(F.col(text)))
    out = with_stats.select(*names, rules.score("s_").alias("score_"))
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*own, F.col("score_").alias("score"), (F.col("score_") >= 0.5).cast("int").alias("predicted"))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), fit(docs.where(~held_out()), labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
