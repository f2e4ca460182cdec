"""Helpers for jobs over embedding tables: valid vectors, shards and the stream of a shard's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(e: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce(e.isNotNull() & fine & (squares > 0), F.lit(False))


def hashes(e: Column) -> list[Column]:
    """128 bits that tell vectors apart."""
    return [F.xxhash64(e).alias("ha_"), F.xxhash64(F.lit("second"), e).alias("hb_")]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a float64 matrix."""
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def against_shards(
    rows: DataFrame, queries: DataFrame, shards: int, blocks: int, work: Callable, kinds: str
) -> DataFrame:
    """Run ``work`` for every (shard of rows, block of queries), each pair in one place.

    ``rows`` and ``queries`` have ``id`` (long), ``e`` (array<double>) and columns of equal names and types
    besides.  A task holds one shard and streams the queries: ``work(shard batch)`` returns a function
    that is given query batches and, with None, called once at the end; both give record batches.  Queries come in the
    order of a hash, in batches of 256 with the rest last, however the rows arrive.
    Vectors of different lengths meet in different calls.
    """
    names = ["id", "e", *[c for c in rows.columns if c not in ("id", "e")]]
    hashed = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")
    r = rows.select(*names, hashed.alias("shard_"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block_"), F.lit(0).alias("asks_"))
    q = queries.select(*names, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard_"), block.alias("block_"), F.lit(1).alias("asks_"))
    both = r.unionByName(q).withColumn("dim_", F.size("e"))
    dealt = both.repartitionById(shards * blocks, F.col("shard_") * blocks + F.col("block_"))
    # By hash, so that the first queries of every task are a random sample.
    ordered = dealt.sortWithinPartitions("dim_", "asks_", F.xxhash64(F.lit("sample"), "id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held, ask, queue = None, [], None, []

        def asked(rest: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(queue)
            ready = table.num_rows if rest else table.num_rows // 256 * 256
            for at in range(0, ready, 256):
                yield from ask(table.slice(at, min(256, ready - at)).combine_chunks().to_batches()[0])
            queue[:] = table.slice(ready).to_batches()

        for whole in batches:
            # Stretches of one vector length and one role.
            key = np.array(whole.column("dim_")) * 2 + np.array(whole.column("asks_"))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.slice(a, b - a)
                d, asks = divmod(int(key[a]), 2)
                if d != dim:
                    if queue:
                        yield from asked(True)
                    if ask:
                        yield from ask(None)
                    dim, held, ask = d, [], None
                if not asks:
                    held.append(part)
                    continue
                if ask is None:
                    ask = work(pa.Table.from_batches(held).combine_chunks() if held else None)
                    held = []
                queue.append(part)
                if sum(q.num_rows for q in queue) >= 256:
                    yield from asked(False)
        if queue:
            yield from asked(True)
        if ask:
            yield from ask(None)

    return ordered.mapInArrow(run, kinds)
