"""Operator 3: mix sources to target weights by exact quotas of blocks.

A source's documents are hashed into blocks, so a block is a random share of its source.  Targets in
words become quotas: whole passes over the source plus a last, partial pass that ends inside one
block.  A splitting tree deals the quotas out: each node halves its range of output shards and draws
the left half's blocks of every source from the multivariate hypergeometric law, so shards hold
random but exactly adding numbers of blocks.  Shards then take disjoint runs of each source's
(hashed, hence permuted) blocks and order what they hold by another hash.

Shuffled data: to plan, per-source and per-block sums only, combined before the shuffle (a hot source is spread over
its blocks); then each taken copy once, to its output shard.  The block in which a source's last pass ends is found from
sums of blocks by digits of its number, 1,024 values at a time, so no task orders all blocks.  The driver
sees one row a source, at most ``max_sources`` (else ValueError); up to 2**30 blocks in all.

Nulls and edge cases: a null text has no words; null is a source of its own, last in order; rows
alike in doc_id and text are dealt alike and share a cut equally; a source without words has target
0; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.runtime import drop_stash, local_table, stash, table


def word_count(text: Column) -> Column:
    r"""Number of runs of anything but blank and ``\x09-\x0D``; null has none."""
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " ", -1), "")).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``most`` times its size, the excess reshared."""
    left, weight, out = float(sum(sizes)), float(sum(weights)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: most * sizes[k] / weights[k])
    for k in order:
        share = left / weight * weights[k] if weight > 0 else 0.0
        out[k] = min(share, most * sizes[k])
        left, weight = left - out[k], weight - weights[k]
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (row) for each shard (column); rows add to ``quotas``."""
    out = np.zeros((len(quotas), shards), np.int64)
    nodes = [(0, shards, np.array(quotas, np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        mid = (low + high) // 2
        rest, draws = int(have.sum()), int(have.sum()) * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = np.zeros_like(have)
        for k, n in enumerate(have.tolist()):
            rest -= n
            left[k] = rng.hypergeometric(n, rest, draws) if n and draws else 0
            draws -= int(left[k])
        nodes += [(low, mid, left), (mid, high, have - left)]
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    shards: int = 64,
    block_words: int = 65_536,
    whole_documents: bool = False,
    seed: int = 20_240,
    max_sources: int = 100_000,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``draws`` added.

    ``weights`` repeat over the sources in code-point order.  ``draws`` has a struct a copy: its output
    ``shard``, its place ``rank`` in the shard's order, and ``words`` (fewer than the size for a copy
    that is cut; with ``whole_documents`` no copy is cut).
    """
    spark = docs.sparkSession
    names = [f"c{i}_" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    plain = docs.toDF(*names)
    key = F.xxhash64(F.lit(seed), F.col(at["doc_id"]).cast("long"), F.col(at["text"]))
    source = F.col(at["source"]).cast("string")
    sized = plain.select(source.alias("source_"), key.alias("key_"), word_count(F.col(at["text"])).alias("size_"))
    sizes = stash(sized, "mix-sizes")

    per_source = sizes.groupBy("source_").agg(F.sum("size_").alias("s")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    # Code-point order is the order of UTF-8 bytes.
    per_source.sort(key=lambda r: (r.source_ is None, (r.source_ or "").encode()))
    total = sum(r.s for r in per_source)
    goal = targets([r.s for r in per_source], [weights[k % len(weights)] for k in range(len(per_source))], most)
    rows = []
    for r, t in zip(per_source, goal, strict=True):
        passes = min(math.floor(most), int(t // r.s)) if r.s else 0
        blocks = max(1, -(-r.s // block_words))
        rows.append((r.source_, r.s, t, blocks, passes, min(round(t), math.floor(most * r.s)) - passes * r.s))
    kinds = "source_ string, source_size_ long, target_ double, blocks_ long, passes_ long, need_ long"
    plan = local_table(spark, rows, kinds)

    def planned(df: DataFrame, by: DataFrame) -> DataFrame:
        # At most max_sources short rows: a proven bound for the broadcast.
        by = by.withColumnRenamed("source_", "planned_")
        return df.join(F.broadcast(by), F.col("source_").eqNullSafe(F.col("planned_"))).drop("planned_")

    def upto(cols: list[str], what: str) -> Column:
        return F.sum(what).over(Window.partitionBy("source_").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0))

    block = F.pmod("key_", "blocks_")
    cut = planned(sizes, plan).where("need_ > 0").withColumn("block_", block)
    words = stash(cut.groupBy("source_", "block_").agg(F.sum("size_").alias("words_")), "mix-blocks")
    ends = {r[0]: (0, r[5]) for r in rows if r[5] > 0}
    most_blocks = max((r[3] for r in rows), default=1)
    for shift in (20, 10, 0):
        if shift and most_blocks <= 1 << shift:
            continue
        state = local_table(spark, [(k, *v) for k, v in ends.items()], "source_ string, prefix_ long, part_ long")
        some = planned(words, state).where(F.shiftright("block_", shift + 10) == F.col("prefix_"))
        some = some.groupBy("source_", "part_", F.shiftright("block_", shift).alias("digit_")).agg(F.sum("words_").alias("words_"))
        some = some.withColumn("upto_", upto(["digit_"], "words_")).where("upto_ >= part_ AND upto_ - words_ < part_")
        ends = {r.source_: (r.digit_, r.part_ - r.upto_ + r.words_) for r in some.collect()}
    drop_stash(words)
    last = local_table(spark, [(k, *v) for k, v in ends.items()], "source_ string, last_ long, part_ long")
    inside = planned(cut, last).where("block_ = last_").groupBy("source_", "part_", "key_").agg(F.sum("size_").alias("words_"))
    inside = inside.withColumn("upto_", upto(["key_"], "words_")).where("upto_ >= part_ AND upto_ - words_ < part_")
    keys = {r.source_: (r.key_, r.part_ - r.upto_ + r.words_, r.words_) for r in inside.collect()}

    drawn = [p * b + (ends[s][0] + 1 if s in ends else 0) for s, _, _, b, p, _ in rows]
    bounds = np.cumsum(split_quotas(drawn, shards, seed), axis=1)
    final = []
    for k, (s, *head) in enumerate(rows):
        end, (edge, part, group) = ends.get(s, (-1, 0))[0], keys.get(s, (0, 0, 1))
        final.append((s, *head, end, edge, part, group, bounds[k, :-1].tolist()))
    kinds += ", last_ long, edge_ long, part_ long, group_ long, bounds_ array<long>"
    plan = local_table(spark, final, kinds)
    drop_stash(sizes)

    out = plain.withColumns({"source_": source, "key_": key, "size_": word_count(F.col(at["text"]))})
    out = planned(out, plan).withColumn("block_", block)
    size = F.col("size_")
    share = F.when(F.col("part_") * 2 >= F.col("group_"), size).otherwise(F.lit(0))
    if not whole_documents:
        share = F.floor(size.cast("decimal(20,0)") * F.col("part_") / F.col("group_")).cast("long")
    extra = (
        F.when((F.col("block_") < F.col("last_")) | ((F.col("block_") == F.col("last_")) & (F.col("key_") < F.col("edge_"))), size)
        .when((F.col("block_") == F.col("last_")) & (F.col("key_") == F.col("edge_")), share)
        .otherwise(F.lit(0).cast("long"))
    )
    out = out.withColumn("extra_", extra)
    copies = F.col("passes_") + F.when(F.col("extra_") > 0, 1).otherwise(0)
    draws = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>")),
        lambda copy: F.struct(
            F.aggregate(
                F.col("bounds_"),
                F.lit(0),
                lambda n, b: n + F.when(b <= copy * F.col("blocks_") + F.col("block_"), 1).otherwise(0),
            ).alias("shard"),
            F.xxhash64(F.col("key_"), copy).alias("rank"),
            F.when(copy < F.col("passes_"), size).otherwise(F.col("extra_")).alias("words"),
        ),
    )
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.withColumn("draws_", draws).select(
        *own,
        size.alias("size"),
        F.col("source_size_").alias("source_size"),
        F.col("target_").alias("target"),
        F.aggregate("draws_", F.lit(0).cast("long"), lambda n, d: n + d["words"]).alias("taken"),
        F.col("draws_").alias("draws"),
    )


def emit(mixed: DataFrame, columns: list[str], shards: int = 64) -> DataFrame:
    """The mix itself: a row a copy with its shard, rank and words, partitioned by output shard and in its order."""
    rows = mixed.select(*columns, F.explode("draws").alias("draw_"))
    dealt = rows.repartitionById(shards, F.col("draw_.shard")).sortWithinPartitions("draw_.shard", "draw_.rank")
    return dealt.select(*columns, F.col("draw_.shard").alias("shard"), F.col("draw_.rank").alias("rank"), F.col("draw_.words").alias("words"))


def op3_mix_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 1, 2, 3: the mix is written with its texts, and the result counted from it.

    ``shards`` names the output shards of a document's copies, in order.  A document of which nothing is taken is
    written as well, without text and shard, so that the files account for every row; rows alike in doc_id, source and
    text are told apart by their number.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    same = [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("b")]
    facts = ["doc_id", "source", "a", "b", "size", "source_size", "target"]
    none = F.array(F.struct(F.lit(None).cast("int").alias("shard"), F.xxhash64("doc_id", "text").alias("rank"), F.lit(0).cast("long").alias("words")))
    mixed = mix(docs).select("*", *same).withColumn("draws", F.when(F.size("draws") > 0, F.col("draws")).otherwise(none))
    rows = mixed.select(*facts, "text", F.posexplode("draws").alias("copy", "draw"))
    rows = rows.select(*facts, "copy", "draw.*", F.when(F.col("draw.shard").isNotNull(), F.col("text")).alias("text"))
    home = F.coalesce("shard", F.pmod("rank", F.lit(64)).cast("int"))
    made = stash(rows.repartitionById(64, home).sortWithinPartitions(F.col("shard").asc_nulls_last(), "rank"), "mix")

    alike = F.sum(F.when(F.col("copy") == 0, 1).otherwise(0))
    counted = made.drop("text").groupBy(facts).agg(
        F.sum("words").alias("words"), alike.alias("rows"), F.array_join(F.sort_array(F.collect_set("shard")), ",").alias("shards")
    )
    each = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    return each.select("doc_id", "size", "source_size", "target", F.expr("words div rows").alias("taken"), "shards")
