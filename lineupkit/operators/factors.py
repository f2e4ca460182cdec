"""Factorisations of a symmetric table of pairs: spectral embedding, non-negative factors, and a regularised inverse.

The matrix is a table of coordinates or of blocks and stays one; products are joins and aggregates.  A factor has one row a
feature with ``k`` numbers.  Only k x k products and sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.operators.corpus import mirrored
from lineupkit.runtime import drop_stash, stash

_ROWS = "feature string, q array<double>"


def _start(names: DataFrame, k: int, salt: str, low: float) -> DataFrame:
    """Numbers from ``low`` to 1 by a hash of feature and column: the same on every run."""
    draw = lambda c: low + (1 - low) * (F.crc32(F.concat_ws("|", F.lit(salt), F.lit(c), "feature")) + 1) / 4294967297.0
    return names.select("feature", F.array(*[draw(c) for c in range(k)]).alias("q"))


def _times(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(feature, q): the product of a symmetric pair table (both orders) and a factor."""
    joined = pairs.join(rows.withColumnRenamed("feature", "j"), "j")
    return joined.groupBy(F.col("i").alias("feature")).agg(F.array(*[F.sum(F.col("x") * F.get("q", F.lit(c))) for c in range(k)]).alias("q"))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), k)


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _mixed(rows: DataFrame, mix: np.ndarray) -> DataFrame:
    """A factor times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("feature"), _arrays(_matrix(b.column("q"), len(mix)) @ mix)], names=["feature", "q"])

    return rows.select("feature", "q").mapInArrow(run, _ROWS)


def _gram(rows: DataFrame, k: int) -> np.ndarray:
    """The k x k product of a factor with itself: one partial sum a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k))
        for b in batches:
            m = _matrix(b.column("q"), k)
            out += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(out.ravel())], names=["at", "s"])

    sums = rows.select("q").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k * k)
    for r in sums:  # k x k rows
        out[r.at] = r.s
    return out.reshape(k, k)


def spectral_embedding(pairs: DataFrame, d: int, oversample: int = 8, rounds: int = 60, steps: int = 2, tol: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """(feature, u, embedding) and the ``d`` largest singular values of a symmetric pair table (i, j, x; i < j, zero diagonal).

    Block subspace iteration: ``steps`` products a round, then the block is made orthonormal by the eigenvectors of its small
    Gram matrix, whose eigenvalues give the singular values.  It ends when these change by less than ``tol`` of the
    largest, or after ``rounds``.  ``u`` are the singular vectors, each with its largest component positive; ``embedding`` is u
    times the root of the singular value, scaled to length 1 (a zero row stays).  Features without pairs have no row.
    """
    both = stash(mirrored(pairs.where("x <> 0"), "x"), "spectral")
    names = both.select(F.col("i").alias("feature")).distinct()
    n = names.count()
    k = min(d + oversample, n)
    d = min(d, n)
    if not n:
        return names.select("feature", F.array().cast("array<double>").alias("u"), F.array().cast("array<double>").alias("embedding")), []
    block = stash(_start(names, k, "spectral", -1.0), "block")
    first = np.linalg.cholesky(_gram(block, k) + 1e-12 * n * np.eye(k))
    mix, before = np.linalg.inv(first).T, None
    for at in range(rounds + 1):
        product = _mixed(block, mix)
        # The last product is a single one, so that its Gram matrix holds the singular values themselves.
        for _ in range(steps if at < rounds else 1):
            product = _times(both, product, k)
        new = stash(product, "block")
        drop_stash(block)
        block, power = new, steps if at < rounds else 1
        values, vectors = np.linalg.eigh(_gram(block, k))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        mix = vectors / np.where(values > values[0] * 1e-28, np.sqrt(np.maximum(values, 1e-300)), np.inf)
        sigma = values ** (0.5 / power)
        if before is not None and np.abs(sigma[:d] - before[:d]).max() <= tol * max(sigma[0], 1e-300):
            break
        before = sigma
    rows = stash(_mixed(block, mix[:, :d]), "vectors")
    peaks = rows.select("feature", F.posexplode("q").alias("c", "x")).groupBy("c").agg(F.max_by("x", F.struct(F.round(F.abs("x"), 9), "feature")).alias("x")).collect()  # d rows
    signs = [1.0] * d
    for r in peaks:
        signs[r.c] = -1.0 if r.x < 0 else 1.0
    u = F.transform("q", lambda x, c: x * F.get(F.array(*[F.lit(s) for s in signs]), c))
    wide = F.transform("u", lambda x, c: x * F.get(F.array(*[F.lit(float(np.sqrt(s))) for s in sigma[:d]]), c))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    out = rows.select("feature", u.alias("u")).withColumn("e", wide).withColumn("n", size)
    return out.select("feature", "u", F.transform("e", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("embedding")), sigma[:d].tolist()


def similarities(embedded: DataFrame) -> DataFrame:
    """(i, j, sim; i < j): cosines of all pairs of a vocabulary's embedding, component by component."""
    long = embedded.select("feature", F.posexplode("embedding").alias("c", "x"))
    both = long.toDF("i", "c", "x").join(long.toDF("j", "c", "y"), "c").where("i < j")
    return both.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))


def role_residuals(sims: DataFrame, pairs: DataFrame, weight: float = 1.0) -> DataFrame:
    """(i, j, sim, x, score; i < j): similarity less ``weight`` times the pair's share of the largest entry: alike without standing together."""
    top = pairs.agg(F.max("x").alias("top_"))
    joined = sims.join(pairs.select("i", "j", "x"), ["i", "j"], "left").fillna(0.0, ["x"]).crossJoin(F.broadcast(top))
    share = F.col("x") / F.when(F.col("top_") > 0, F.col("top_")).otherwise(1.0)
    return joined.select("i", "j", "sim", "x", (F.col("sim") - weight * share).alias("score"))


def closest_substitutes(residuals: DataFrame) -> DataFrame:
    """(feature, substitute, score, sim, x): each feature's best partner by residual score; the lowest scores are the isolated features."""
    both = mirrored(residuals, "sim", "x", "score")
    best = both.groupBy(F.col("i").alias("feature")).agg(F.min(F.struct((-F.round("score", 12)).alias("s"), "j", "score", "sim", "x")).alias("b"))
    return best.select("feature", F.col("b.j").alias("substitute"), "b.score", "b.sim", "b.x")


def nonnegative_factors(pairs: DataFrame, ks: list[int], rounds: int = 30) -> tuple[DataFrame, list[dict]]:
    """(k, feature, component, w, h) and a history of (k, round, error, correlation) of P ≈ W H for every rank of ``ks``.

    Multiplicative updates; all ranks are columns of one wide factor and share the products with the table, their Gram matrices
    are kept apart.  The error is the Frobenius norm of P - W H over that of P; it never rises.  ``correlation`` is
    that of W and Hᵀ.  Starts from hashes.  Features without pairs have no row.
    """
    both = stash(mirrored(pairs.where("x > 0"), "x"), "factors")
    names, total = stash(both.select(F.col("i").alias("feature")).distinct(), "names"), both.agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s2")).first()
    n, k = names.count(), sum(ks)
    cuts = np.cumsum([0, *ks])
    mask = np.zeros((k, k))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mask[a:b, a:b] = 1
    if not n:
        none = F.lit(None).cast("double")
        return names.select(F.lit(0).alias("k"), "feature", F.lit(0).alias("component"), none.alias("w"), none.alias("h")), []
    scale = np.repeat([(total.s / (n * n) / size) ** 0.5 for size in ks], ks)
    w, h = (stash(_mixed(_start(names, k, salt, 0.01), np.diag(2 * scale)), "factor") for salt in ("w", "h"))

    def updated(factor: DataFrame, product: DataFrame, gram: np.ndarray) -> DataFrame:
        """The factor after one update, with what the error needs: its entries times the product."""
        inner = gram * mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                old, top = _matrix(b.column("q"), k), _matrix(b.column("p"), k)
                new = old * top / np.maximum(old @ inner, 1e-300)
                yield pa.RecordBatch.from_arrays([b.column("feature"), _arrays(new), _arrays(new * top)], names=["feature", "q", "cross"])

        joined = factor.select("feature", "q").join(product.withColumnRenamed("q", "p"), "feature")
        return stash(joined.mapInArrow(run, f"{_ROWS}, cross array<double>"), "factor")

    history, gram_w = [], _gram(w, k)
    for at in range(1, rounds + 1):
        new = updated(h, _times(both, w, k), gram_w)
        drop_stash(h)
        h, gram_h = new, _gram(new, k)
        new = updated(w, _times(both, h, k), gram_h)
        drop_stash(w)
        w, gram_w = new, _gram(new, k)
        cross = np.zeros(k)
        for r in w.select(F.posexplode("cross").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).collect():  # k rows
            cross[r.c] = r.x
        for size, a, b in zip(ks, cuts[:-1], cuts[1:], strict=True):
            left = total.s2 - 2 * cross[a:b].sum() + (gram_w * gram_h)[a:b, a:b].sum()
            history.append({"k": size, "round": at, "error": float(np.sqrt(max(left, 0) / total.s2))})
    place = lambda c: F.element_at(F.array(*[F.lit(x) for size in ks for x in [size] * size]), c + 1)
    start = F.element_at(F.array(*[F.lit(int(a)) for size, a in zip(ks, cuts[:-1], strict=True) for _ in range(size)]), F.col("c") + 1)
    joined = w.select("feature", F.col("q").alias("w_")).join(h.select("feature", F.col("q").alias("h_")), "feature")
    long = joined.select("feature", F.posexplode(F.arrays_zip("w_", "h_")).alias("c", "z"))
    long = stash(long.select(place(F.col("c")).alias("k"), "feature", (F.col("c") - start + 1).alias("component"), F.col("z.w_").alias("w"), F.col("z.h_").alias("h")), "factors-out")
    alike = {r.k: r.r for r in long.groupBy("k").agg(F.corr("w", "h").alias("r")).collect()}  # one row a rank
    return long, [x | {"correlation": float(alike[x["k"]]) if alike[x["k"]] is not None else None} for x in history]


def blocks(pairs: DataFrame, diagonal: float, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(bi, bj, m): a symmetric matrix in square blocks (zero-padded, with ones on the diagonal beyond its end), and its index (feature, k)."""
    names = pairs.select(F.col("i").alias("feature")).union(pairs.select("j")).distinct()
    index = stash(names.withColumn("k", (F.row_number().over(Window.orderBy("feature")) - 1).cast("int")), "index")  # a vocabulary is a short list
    n = index.count()
    both = mirrored(pairs, "x").join(index.toDF("i", "r"), "i").join(index.toDF("j", "c"), "j").select("r", "c", "x")
    spark = pairs.sparkSession
    ones = spark.range(-(-n // size) * size).select(F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"), F.when(F.col("id") < n, diagonal).otherwise(1.0).alias("x"))
    cells = both.unionByName(ones).select((F.col("r") / size).cast("int").alias("bi"), (F.col("c") / size).cast("int").alias("bj"), (F.col("r") % size).alias("r"), (F.col("c") % size).alias("c"), "x")

    def block(group: pd.DataFrame) -> pd.DataFrame:  # at most size x size rows
        m = np.zeros((size, size))
        m[group["r"], group["c"]] = group["x"]
        return pd.DataFrame({"bi": group["bi"].iloc[:1], "bj": group["bj"].iloc[:1], "m": [m.tobytes()]})

    return stash(cells.groupBy("bi", "bj").applyInPandas(block, "bi int, bj int, m binary"), "blocks"), index


def block_product(a: DataFrame, b: DataFrame, size: int = 64, scale: float = 1.0, identity: float = 0.0) -> DataFrame:
    """``scale`` A B + ``identity`` I: blocks that share the inner index meet in a join, their products are added by place."""
    pairs = a.select("bi", F.col("bj").alias("k"), "m").join(b.select(F.col("bi").alias("k"), "bj", F.col("m").alias("n")), "k")
    square = lambda x: np.frombuffer(x).reshape(size, size)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame({"bi": t["bi"], "bj": t["bj"], "m": [(square(x) @ square(y)).tobytes() for x, y in zip(t["m"], t["n"], strict=True)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:  # one row a block column
        m = scale * sum(square(x) for x in group["m"])
        if group["bi"].iloc[0] == group["bj"].iloc[0]:
            m = m + identity * np.eye(size)
        return pd.DataFrame({"bi": group["bi"].iloc[:1], "bj": group["bj"].iloc[:1], "m": [m.tobytes()]})

    kind = "bi int, bj int, m binary"
    return stash(pairs.mapInPandas(multiply, kind).groupBy("bi", "bj").applyInPandas(add, kind), "blocks")


def _block_sum(a: DataFrame, of: str, size: int) -> float:
    """The largest row sum of absolute entries, or the Frobenius distance from the identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for bi, bj, m in zip(t["bi"], t["bj"], t["m"], strict=True):
                x = np.frombuffer(m).reshape(size, size)
                rest = x - np.eye(size) if bi == bj else x
                yield pd.DataFrame({"r": bi * size + np.arange(size), "s": np.abs(x).sum(1), "q": (rest * rest).sum(1)})

    rows = a.mapInPandas(run, "r long, s double, q double").groupBy("r").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    found = rows.agg(F.max("s").alias("s"), F.sum("q").alias("q")).first()
    return found.s if of == "norm" else float(np.sqrt(found.q))


def inverse(pairs: DataFrame, diagonal: float, size: int = 64, rounds: int = 100, tol: float = 1e-11) -> tuple[DataFrame, float]:
    """(i, j, x; i <= j) of the inverse of a symmetric matrix, and the norm of A X - I.

    ``pairs`` (i, j, x; i < j) beside one value on the diagonal.  Newton and Schulz: X <- X (2 I - A X) from A over its
    squared row-sum norm, in products of blocks; it ends below ``tol`` or once the residual no longer falls.  A singular
    matrix is an error.
    """
    a, index = blocks(pairs, diagonal, size)
    if index.isEmpty():
        return pairs.limit(0).select("i", "j", "x"), 0.0
    norm = _block_sum(a, "norm", size)
    x, last = _scaled(a, 1 / (norm * norm), size), None
    for _ in range(rounds):
        rest = block_product(a, x, size, -1.0, 2.0)  # 2 I - A X, as far from I as A X is
        far = _block_sum(rest, "distance", size)
        if far < tol or (last is not None and last < 1e-3 and far >= last):
            break
        new = block_product(x, rest, size)
        drop_stash(x)
        drop_stash(rest)
        x, last = new, far
    else:
        raise ValueError("the matrix is singular or too close to it")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for bi, bj, m in zip(t["bi"], t["bj"], t["m"], strict=True):
                r, c = np.divmod(np.arange(size * size), size)
                yield pd.DataFrame({"r": (bi * size + r).astype(np.int32), "c": (bj * size + c).astype(np.int32), "x": np.frombuffer(m)})

    long = x.mapInPandas(cells, "r int, c int, x double").where("r <= c")
    return long.join(index.toDF("i", "r"), "r").join(index.toDF("j", "c"), "c").select("i", "j", "x"), far


def _scaled(a: DataFrame, by: float, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(m=[(np.frombuffer(x) * by).tobytes() for x in t["m"]])

    return stash(a.mapInPandas(run, "bi int, bj int, m binary"), "blocks")


def gaussian_couplings(correlations: DataFrame, epsilon: float, size: int = 64) -> tuple[DataFrame, float]:
    """(i, j, coupling; i < j): minus the inverse of the correlations with ``epsilon`` added to the diagonal, and the residual.

    ``correlations`` (i, j, corr; i < j) of every pair of features.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    found, far = inverse(correlations.select("i", "j", F.col("corr").alias("x")), 1 + epsilon, size)
    return found.where("i < j").select("i", "j", (-F.col("x")).alias("coupling")), far
