"""Pseudo-likelihood fit of fields and couplings: one logistic regression a feature, all fitted together.

The corpus stays distributed: every evaluation is one pass in which each task sums loss and gradient of all features over
its rosters, summed again by feature in two levels.  The driver holds the parameters alone (a vocabulary squared, at most
``max_features``) and steps each feature by its own limited-memory quasi-Newton direction, halving the step of those whose loss
did not fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineupkit.operators.corpus import align_prior, marginals, mirrored, vocabulary
from lineupkit.runtime import drop_stash, stash

#: Evidence in either class below which a feature is not fitted.
LEAST_EVIDENCE = 2.0


def coded_rosters(members: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """(ids, w, n): distinct rosters as ids of ``names``, weight and number of their teams; teams without known members count."""
    ids = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(k))])
    known = members.select("team_id", F.try_element_at(ids, F.col("feature")).alias("id")).where("id IS NOT NULL")
    held = known.groupBy("team_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = weights.join(held, "team_id", "left").select(F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), "w")
    return rows.groupBy("ids").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def _dense(ids: pd.Series, v: int) -> np.ndarray:
    x = np.zeros((len(ids), v))
    rows = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    if len(rows):
        x[rows, np.concatenate(ids.to_numpy()).astype(int)] = 1
    return x


def _evaluate(rosters: DataFrame, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every feature: Σ w (log(1 + e^z) - y z) over all rosters."""
    v = len(theta)
    shared = rosters.sparkSession.sparkContext.broadcast(theta)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value[:, :v], shared.value[:, v]
        loss, grad = np.zeros(v), np.zeros((v, v + 1))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                x, w = _dense(some["ids"], v), some["w"].to_numpy()[:, None]
                z = x @ a.T + b
                loss += (w * (np.logaddexp(0, z) - x * z)).sum(0)
                r = w * (0.5 * (1 + np.tanh(z / 2)) - x)
                grad[:, :v] += r.T @ x
                grad[:, v] += r.sum(0)
        lot = TaskContext.get().partitionId() // 64
        yield pd.DataFrame({"lot": lot, "spin": np.arange(v), "loss": loss, "grad": [g.tobytes() for g in grad]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1].copy()
        out["loss"], out["grad"] = group["loss"].sum(), sum(np.frombuffer(g) for g in group["grad"]).tobytes()
        return out

    kind = "lot int, spin int, loss double, grad binary"
    parts = rosters.mapInPandas(part, kind).groupBy("lot", "spin").applyInPandas(add, kind)
    whole = parts.withColumn("lot", F.lit(0)).groupBy("lot", "spin").applyInPandas(add, kind)
    loss, grad = np.zeros(v), np.zeros((v, v + 1))
    for r in whole.collect():  # one row a feature
        loss[r.spin], grad[r.spin] = r.loss, np.frombuffer(bytes(r.grad))
    shared.destroy()
    grad[np.arange(v), np.arange(v)] = 0
    return loss, grad


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton directions of all features at once; a pair without curvature is left out for its feature."""
    q, kept = grad.copy(), []
    for s, y in reversed(steps):
        sy = (s * y).sum(1)
        rho = np.where(sy > 1e-12, 1 / np.where(sy > 1e-12, sy, 1), 0)
        alpha = rho * (s * q).sum(1)
        q -= alpha[:, None] * y
        kept.append((s, y, rho, alpha))
    if steps:
        s, y = steps[-1]
        yy, sy = (y * y).sum(1), (s * y).sum(1)
        q *= np.where((yy > 0) & (sy > 1e-12), sy / np.where(yy > 0, yy, 1), 1)[:, None]
    for s, y, rho, alpha in reversed(kept):
        q += s * (alpha - rho * (y * q).sum(1))[:, None]
    return -q


def fit_rows(rosters: DataFrame, v: int, c: float = 0.1, prior: np.ndarray | None = None, intercept_weight: float = 1.0, rounds: int = 300, tol: float = 1e-5) -> np.ndarray:
    """(v, v + 1): each feature's coefficients on the others (0 on itself) and its intercept.

    Minimises ½|β - β0|² + ½ p (b - b0)² + c Σ w logloss; β0, b0 are ``prior`` or 0, p is ``intercept_weight`` with a prior and 0
    without.  A feature with raw or weighted evidence below 2 in either class keeps its prior, or 0.
    """
    if c <= 0:
        raise ValueError("c must be positive")
    centre = np.zeros((v, v + 1)) if prior is None else prior.astype(float).copy()
    centre[np.arange(v), np.arange(v)] = 0
    pull = np.ones(v + 1)
    pull[v] = 0 if prior is None else intercept_weight
    totals = rosters.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("w").alias("least")).first()
    if totals.n is None:
        return centre
    if totals.least < 0:
        raise ValueError("weights must be nonnegative")
    on = np.zeros((v, 2))
    for r in rosters.select(F.explode("ids").alias("id"), "w", "n").groupBy("id").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
        on[r.id] = r.w, r.n
    off = np.array([totals.w, totals.n]) - on
    fitted = (np.minimum(on, off) >= LEAST_EVIDENCE - 1e-12).all(1)[:, None]

    def value(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, grad = _evaluate(rosters, theta)
        far = theta - centre
        return c * loss + 0.5 * (pull * far * far).sum(1), np.where(fitted, c * grad + pull * far, 0)

    theta = centre.copy()
    f, g = value(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    d, t = -g, 1 / np.maximum(1, np.sqrt((g * g).sum(1)))
    for _ in range(rounds):
        live = (np.abs(g).max(1) > tol) & (t > 1e-10)
        if not live.any():
            break
        new = theta + np.where(live, t, 0)[:, None] * d
        f_new, g_new = value(new)
        good = live & (f_new <= f + 1e-4 * t * (g * d).sum(1) + 1e-12 * np.abs(f))
        move = good[:, None]
        steps = [*steps[-9:], (np.where(move, new - theta, 0), np.where(move, g_new - g, 0))]
        theta, f, g = np.where(move, new, theta), np.where(good, f_new, f), np.where(move, g_new, g)
        d = np.where(move, _direction(g, steps), d)
        t = np.where(good, 1.0, t / 2)
        # A direction that does not descend gives way to the gradient.
        bad = ((d * g).sum(1) >= 0) & live
        d, t = np.where(bad[:, None], -g, d), np.where(bad, 1 / np.maximum(1, np.sqrt((g * g).sum(1))), t)
    return theta


def fit_model(
    members: DataFrame, weights: DataFrame, vocab: DataFrame, c: float = 0.1, prior: tuple[DataFrame, DataFrame] | None = None,
    intercept_weight: float = 1.0, max_features: int = 4_000,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields (feature, h), couplings (i, j, coupling; i < j, the mean of both directions), and the raw rows (i, j, coupling).

    ``prior``: fields and couplings of another model; what it lacks has prior 0.
    """
    spark = members.sparkSession
    names = sorted(r.feature for r in vocab.select("feature").limit(max_features + 1).collect())
    if len(names) > max_features:
        raise ValueError(f"more than {max_features} features")
    v, at = len(names), {f: k for k, f in enumerate(names)}
    centre = None
    if prior is not None:
        centre = np.zeros((v, v + 1))
        h, kept = align_prior(vocab, *prior)
        for r in h.collect():
            centre[at[r.feature], v] = r.h
        for r in mirrored(kept, "coupling").collect():
            centre[at[r.i], at[r.j]] = r.coupling
    rosters = stash(coded_rosters(members, weights, names), "fit-rosters")
    theta = fit_rows(rosters, v, c, centre, intercept_weight) if v else np.zeros((0, 1))
    drop_stash(rosters)
    a, b = np.triu_indices(v, 1)
    name = np.array(names, object)
    strings = lambda x: pa.array(list(x), pa.string())
    fields = spark.createDataFrame(pa.table({"feature": strings(names), "h": pa.array(theta[:, v] if v else [], pa.float64())}))
    raw = theta[:, :v]
    couplings = spark.createDataFrame(pa.table({"i": strings(name[a]), "j": strings(name[b]), "coupling": pa.array((raw[a, b] + raw[b, a]) / 2, pa.float64())}))
    i, j = np.nonzero(~np.eye(v, dtype=bool))
    rows = spark.createDataFrame(pa.table({"i": strings(name[i]), "j": strings(name[j]), "coupling": pa.array(raw[i, j], pa.float64())}))
    return fields, couplings, rows


def build_model(members: DataFrame, weights: DataFrame, cutoff: float, c: float = 0.1, prior: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Vocabulary, marginals, fields, couplings and raw rows of a corpus: features below ``cutoff`` are left out of the rosters."""
    vocab = vocabulary(members, weights, cutoff, prior[0] if prior else None)
    fields, couplings, rows = fit_model(members, weights, vocab, c, prior)
    return {"vocab": vocab, "marginals": marginals(members, weights).join(vocab.select("feature"), "feature"), "fields": fields, "couplings": couplings, "rows": rows}


def pair_features(members: DataFrame) -> DataFrame:
    """(team_id, feature) of (team_id, species, item): a missing item is the item None."""
    return members.select("team_id", F.concat_ws(" @ ", "species", F.coalesce("item", F.lit("None"))).alias("feature")).distinct()


def mean_field_fields(m: DataFrame, couplings: DataFrame) -> DataFrame:
    """(feature, h): logit(m) - Σ J m."""
    pull = mirrored(couplings, "coupling").join(m.select(F.col("feature").alias("j"), F.col("m").alias("mj")), "j").groupBy(F.col("i").alias("feature")).agg(F.sum(F.col("coupling") * F.col("mj")).alias("p"))
    both = m.where("m > 0 AND m < 1").join(pull, "feature", "left").fillna(0.0, ["p"])
    return both.select("feature", (F.ln(F.col("m") / (1 - F.col("m"))) - F.col("p")).alias("h"))


def symmetry(rows: DataFrame) -> DataFrame:
    """(r): correlation of a fit's two directions."""
    back = rows.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("coupling").alias("back"))
    return rows.where("i < j").join(back, ["i", "j"]).agg(F.corr("coupling", "back").alias("r"))


def prefix_fits(members: DataFrame, rows: DataFrame, sizes: list[int | None], cutoff: float = 1, c: float = 0.1) -> DataFrame:
    """(n_used, i, j, coupling): the fit on the first of ``rows`` (team_id from 1), for every size (None: all).  All rows weigh 1, empty ones too.

    Each fit is its own distributed run; the sizes are a short list.  ``n_used`` of None is -1.
    """
    out = []
    for size in sizes:
        some, used = (x if size is None else x.where(F.col("team_id") <= size) for x in (members, rows))
        weights = used.select("team_id").withColumn("w", F.lit(1.0))
        out.append(build_model(some, weights, cutoff, c)["couplings"].select(F.lit(-1 if size is None else size).alias("n_used"), "i", "j", "coupling"))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both
