"""Many pseudo-likelihood fits at once: a grid of penalties, strengths and weightings in one pass over the corpus a round.

A cell of the grid is a penalty (l2 or l1), a strength ``c`` and a weighting of the teams.  Its parameters are one row a feature, and
the rows of all cells are stacked: a task goes through its rosters once and adds up loss and gradient of all rows that
are still live; settled rows drop out.  l2 rows step as in ``fit.fit_rows``; l1 rows by an orthant-wise step: the
pseudo-gradient leaves out coordinates that the penalty holds at zero, and a step ends where a coordinate would change sign.

The driver and every task hold cells x vocabulary² numbers, at most ``max_values``, else an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineupkit.operators.fit import LEAST_EVIDENCE, _dense, _direction
from lineupkit.runtime import drop_stash, stash


@dataclass(frozen=True)
class Cell:
    """Minimise c Σ w logloss + ½|β|² (l2, intercept free) or + |β| + |b| (l1, intercept penalised too)."""

    c: float
    penalty: str = "l2"
    weighting: int = 0

    def __post_init__(self) -> None:
        if self.c <= 0 or self.penalty not in ("l1", "l2"):
            raise ValueError("c must be positive and the penalty l1 or l2")


def grid_rosters(members: DataFrame, weightings: list[DataFrame], names: list[str]) -> DataFrame:
    """(ids, ws, n): distinct rosters as ids of ``names``, one weight a weighting, number of teams; teams without known members count.

    A team counts if every weighting has it.
    """
    ids = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(k))])
    held = members.select("team_id", F.try_element_at(ids, F.col("feature")).alias("id")).where("id IS NOT NULL").groupBy("team_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = weightings[0].select("team_id", F.col("w").alias("w0"))
    for k, more in enumerate(weightings[1:], 1):
        rows = rows.join(more.select("team_id", F.col("w").alias(f"w{k}")), "team_id")
    rows = rows.join(held, "team_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return rows.groupBy("ids").agg(F.array(*[F.sum(f"w{k}") for k in range(len(weightings))]).alias("ws"), F.count("*").alias("n"))


def evaluate(rosters: DataFrame, theta: np.ndarray, spin: np.ndarray, weighting: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of every parameter row, Σ w (log(1 + e^z) - y z): one pass over the rosters.

    ``weighting`` -1 weighs each team once.
    """
    v, n = theta.shape[1] - 1, len(theta)
    shared = rosters.sparkSession.sparkContext.broadcast((theta, spin, weighting))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theta, spin, weighting = shared.value
        loss, grad = np.zeros(n), np.zeros((n, v + 1) if gradient else (0, 0))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024]
                x, ws = _dense(some["ids"], v), np.column_stack([some["n"].to_numpy(float), np.stack(some["ws"].to_numpy())])
                for low in range(0, n, 1024):
                    rows = slice(low, low + 1024)
                    z, y, w = x @ theta[rows, :v].T + theta[rows, v], x[:, spin[rows]], ws[:, weighting[rows] + 1]
                    loss[rows] += (w * (np.logaddexp(0, z) - y * z)).sum(0)
                    if gradient:
                        r = w * (0.5 * (1 + np.tanh(z / 2)) - y)
                        grad[rows, :v] += r.T @ x
                        grad[rows, v] += r.sum(0)
        yield pd.DataFrame({"row": np.arange(n), "loss": loss, "grad": [g.tobytes() for g in grad] if gradient else [b""] * n})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        out = group.iloc[:1].copy()
        out["loss"], out["grad"] = group["loss"].sum(), sum(np.frombuffer(g) for g in group["grad"]).tobytes()
        return out

    kind = "row int, loss double, grad binary"
    # One part a task, and no more tasks than cores: what is sent does not grow with the corpus.
    few = rosters.coalesce(max(1, rosters.sparkSession.sparkContext.defaultParallelism))
    loss, grad = np.zeros(n), np.zeros((n, v + 1))
    for r in few.mapInPandas(part, kind).groupBy("row").applyInPandas(add, kind).toLocalIterator():  # one row a parameter row
        loss[r.row] = r.loss
        if gradient:
            grad[r.row] = np.frombuffer(bytes(r.grad))
    shared.destroy()
    return loss, grad


def _pseudo(theta: np.ndarray, g: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The steepest one-sided derivatives of loss + bound |θ|; without a bound the gradient."""
    at_zero = np.sign(g) * np.maximum(np.abs(g) - bound, 0)
    return np.where(theta == 0, at_zero, g + bound * np.sign(theta))


def fit_cells(rosters: DataFrame, v: int, cells: list[Cell], rounds: int = 300, tol: float = 1e-5, max_values: int = 100_000_000) -> np.ndarray:
    """(cells, v, v + 1): each feature's coefficients on the others (0 on itself) and its intercept, in every cell.

    A feature with raw or weighted evidence below 2 in either class is 0 throughout.  ``rosters`` as of ``grid_rosters``.
    """
    g = len(cells)
    if g * v * (v + 1) > max_values:
        raise ValueError("the grid is too large")
    theta = np.zeros((g * v, v + 1))
    sums = rosters.select(F.posexplode("ws").alias("k", "w"), "n").groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.min("w").alias("least")).collect()  # one row a weighting
    if not sums or not v:
        return theta.reshape(g, v, v + 1)
    if min(r.least for r in sums) < 0:
        raise ValueError("weights must be nonnegative")
    spin, cell = np.tile(np.arange(v), g), np.repeat(np.arange(g), v)
    weighting = np.array([cells[k].weighting for k in cell])
    total = {r.k: (r.w, r.n) for r in sums}
    on = np.zeros((len(total), v, 2))
    held = rosters.select(F.explode("ids").alias("id"), "ws", "n").select("id", F.posexplode("ws").alias("k", "w"), "n")
    for r in held.groupBy("k", "id").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():  # one row a feature and weighting
        on[r.k, r.id] = r.w, r.n
    off = np.array([total[k] for k in range(len(total))])[:, None, :] - on
    fitted = (np.minimum(on, off) >= LEAST_EVIDENCE - 1e-12).all(2)[weighting, spin]
    c = np.array([cells[k].c for k in cell])
    lasso = np.array([cells[k].penalty == "l1" for k in cell])
    bound = np.where(lasso[:, None], 1.0, 0.0) * np.ones(v + 1)
    pull = np.where(lasso[:, None], 0.0, 1.0) * np.r_[np.ones(v), 0.0]
    rows = np.arange(g * v)

    def value(theta: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objective and smooth gradient of the rows ``some``."""
        loss, grad = evaluate(rosters, theta[some], spin[some], weighting[some])
        t = theta[some]
        f = c[some] * loss + 0.5 * (pull[some] * t * t).sum(1) + (bound[some] * np.abs(t)).sum(1)
        grad = c[some][:, None] * grad + pull[some] * t
        grad[np.arange(len(some)), spin[some]] = 0
        return f, grad

    live = rows[fitted]
    f, grad = np.zeros(g * v), np.zeros_like(theta)
    if len(live):
        f[live], grad[live] = value(theta, live)
    lean = _pseudo(theta, grad, bound)
    first = lambda p: 1 / np.maximum(1, np.sqrt((p * p).sum(1)))
    d, t = -lean, first(lean)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        live = rows[fitted & (np.abs(lean).max(1) > tol) & (t > 1e-10)]
        if not len(live):
            break
        new = theta + t[:, None] * d
        # An l1 row stays in its orthant: that of its signs, or where it is 0 that of its steepest way.
        orthant = np.where(theta != 0, np.sign(theta), -np.sign(lean))
        new = np.where(lasso[:, None] & (np.sign(new) != orthant), 0.0, new)
        f_new, grad_new = f.copy(), grad.copy()
        f_new[live], grad_new[live] = value(new, live)
        fall = (lean * (new - theta)).sum(1)
        good = np.zeros(len(rows), bool)
        good[live] = f_new[live] <= f[live] + 1e-4 * fall[live] + 1e-12 * np.abs(f[live])
        move = good[:, None]
        steps = [*steps[-9:], (np.where(move, new - theta, 0), np.where(move, grad_new - grad, 0))]
        theta, f, grad = np.where(move, new, theta), np.where(good, f_new, f), np.where(move, grad_new, grad)
        lean = _pseudo(theta, grad, bound)
        ahead = _direction(lean, steps)
        # The active set of an l1 row: what its pseudo-gradient holds at 0, or would send the other way, stays.
        ahead = np.where(lasso[:, None] & ((ahead * lean >= 0) | ((theta == 0) & (lean == 0))), 0.0, ahead)
        d, t = np.where(move, ahead, d), np.where(good, 1.0, t / 2)
        bad = (d * lean).sum(1) >= 0
        d, t = np.where(bad[:, None], -lean, d), np.where(bad, first(lean), t)
    return theta.reshape(g, v, v + 1)


def symmetric(theta: np.ndarray) -> np.ndarray:
    """Couplings as the mean of both directions, fields as they are."""
    v = theta.shape[1]
    out = theta.copy()
    out[:, :, :v] = (theta[:, :, :v] + theta[:, :, :v].transpose(0, 2, 1)) / 2
    return out


def mean_pseudo_likelihood(rosters: DataFrame, theta: np.ndarray) -> np.ndarray:
    """Mean over teams of the pseudo-log-likelihood under each cell's symmetric model: one pass for all cells."""
    g, v = theta.shape[:2]
    n = rosters.agg(F.sum("n")).first()[0] or 0
    if not n or not v:
        return np.zeros(g)
    loss, _ = evaluate(rosters, symmetric(theta).reshape(g * v, v + 1), np.tile(np.arange(v), g), np.full(g * v, -1), gradient=False)
    return -loss.reshape(g, v).sum(1) / n


def model_ranks(problems: DataFrame, names: list[str], theta: np.ndarray) -> DataFrame:
    """(cell, team_id, truth, rank): place of every held-out feature by h + Σ J over the held ones, one more than those strictly better.

    ``problems`` (team_id, feature, held_out); held features are no candidates, features that the model lacks no problems.
    """
    v = len(names)
    ids = F.create_map(*[x for k, f in enumerate(names) for x in (F.lit(f), F.lit(k))])
    coded = problems.select("team_id", "held_out", F.try_element_at(ids, F.col("feature")).alias("id")).where("id IS NOT NULL")
    rows = coded.groupBy("team_id").agg(
        F.collect_set(F.when(~F.col("held_out"), F.col("id"))).alias("held"), F.sort_array(F.collect_set(F.when(F.col("held_out"), F.col("id")))).alias("asked")
    ).where(F.size("asked") > 0)
    shared = rows.sparkSession.sparkContext.broadcast((symmetric(theta), np.array(names, object)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                x = _dense(some["held"], v)
                team = np.repeat(some["team_id"].to_numpy(), [len(a) for a in some["asked"]])
                row = np.repeat(np.arange(len(some)), [len(a) for a in some["asked"]])
                truth = np.concatenate(some["asked"].to_numpy()).astype(int)
                for cell, m in enumerate(model):
                    z = np.where(x > 0, -np.inf, x @ m[:, :v].T + m[:, v])
                    own = z[row, truth]
                    # Sums in another order differ in the last digits: what is as good within these is no better.
                    rank = 1 + (z[row] > own[:, None] + 1e-12).sum(1)
                    yield pd.DataFrame({"cell": cell, "team_id": team, "truth": known[truth], "rank": rank})

    return rows.mapInPandas(run, "cell int, team_id long, truth string, rank long")


def fit_grid(members: DataFrame, weightings: list[DataFrame], vocab: DataFrame, cells: list[Cell], max_features: int = 4_000, **more) -> tuple[list[str], np.ndarray]:
    """Features in order, and the parameters of every cell."""
    names = sorted(r.feature for r in vocab.select("feature").limit(max_features + 1).collect())
    if len(names) > max_features:
        raise ValueError(f"more than {max_features} features")
    rosters = stash(grid_rosters(members, weightings, names), "grid-rosters")
    theta = fit_cells(rosters, len(names), cells, **more)
    drop_stash(rosters)
    return names, theta


def couplings_of(spark, names: list[str], theta: np.ndarray) -> DataFrame:
    """(cell, i, j, coupling; i < j) of all cells."""
    g, v = theta.shape[:2]
    a, b = np.triu_indices(v, 1)
    name, sym = np.array(names, object), symmetric(theta)
    parts = {"cell": np.repeat(np.arange(g, dtype=np.int32), len(a)), "i": list(np.tile(name[a], g)), "j": list(np.tile(name[b], g)), "coupling": sym[:, a, b].ravel()}
    kinds = {"cell": pa.int32(), "i": pa.string(), "j": pa.string(), "coupling": pa.float64()}
    return spark.createDataFrame(pa.table({k: pa.array(x, kinds[k]) for k, x in parts.items()}))


def grid_metrics(spark, train: DataFrame, test: DataFrame, problems: DataFrame, names: list[str], theta: np.ndarray) -> DataFrame:
    """One row a cell: train_pll, test_pll, hit1, hit5, mrr, sparsity (share of |J| < 1e-6), mean_abs.

    ``train`` and ``test`` are rosters (ids, ws, n), ``problems`` as of ``model_ranks``.
    """
    a, b = np.triu_indices(len(names), 1)
    j = np.abs(symmetric(theta)[:, a, b])
    near, far = mean_pseudo_likelihood(train, theta), mean_pseudo_likelihood(test, theta)
    rows = [(k, float(near[k]), float(far[k]), float((j[k] < 1e-6).mean()) if len(a) else 0.0, float(j[k].mean()) if len(a) else 0.0) for k in range(len(theta))]
    names_ = ["cell", "train_pll", "test_pll", "sparsity", "mean_abs"]
    kinds = [pa.int32(), *[pa.float64()] * 4]
    known = spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names_))
    ranks = model_ranks(problems, names, theta)
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hit{k}")
    found = ranks.groupBy("cell").agg(hit(1), hit(5), F.avg(1.0 / F.col("rank")).alias("mrr"))
    return known.join(found, "cell", "left")
