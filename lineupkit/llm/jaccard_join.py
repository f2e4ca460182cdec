"""Operator 6: n-gram Jaccard join by rare-first prefixes, classes and links without all pairs.

1. Document frequencies of all shingles are counted into a table of fixed size (2**20 cells), over all
   documents; a shingle's rank is (count of its cell, hash), rarest first.  The rank only decides the
   order, so cells shared by several shingles cost time, never a link.
2. Texts with equal sets form a class, which one document stands for.  Each class posts the prefix of
   its ranked set: two sets that link share a prefix shingle.
3. In every posting list the members are compared with one leader (a star, not all pairs), through the
   length, positional and suffix filters, and each surviving pair is verified once on the full sets.
   Verified links are joined to components.
4. A leader has met its whole list and leaves it.  In lists that still hold several components, everyone
   outside the main one is compared with one of its members, in a few rounds; then all pairs across
   components that are left are examined.  A pair inside a component needs no check, so components are
   exact and a group of near copies costs stars, not squares.

The suffix filter bounds the overlap by the two sets' histograms over 256 ranges of the hash.  Sets
are recomputed from the text for the classes in surviving pairs alone, which a bitmap of fixed size
(2 MB) picks out during the scan.

Nulls and edge cases: null or blank texts have an empty set and link with nothing; rows alike are one
class; a row without doc_id gets a null component and never stands for a class; rows that share a
doc_id count each by its own text; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm.components import components
from lineupkit.llm.shingles import batch_sets, set_id
from lineupkit.llm.workers import bound_batches, release
from lineupkit.runtime import drop_stash, local_table, stash, table

_CELL_BITS, _BLOCK = 20, 1 << 12
_RANGES = 256
_BITMAP_BITS = 24
#: Sets so large that a range may hold more than a short counts are not bounded by ranges.
_MOST_RANGED = 1 << 21


def _frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """Documents per cell of the shingles' top bits: 2**20 counts, summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << _CELL_BITS, np.int64)
        for batch in batches:
            for own in batch_sets(batch.column(0), n):
                np.add.at(cells, (own >> np.uint64(64 - _CELL_BITS)).astype(np.int64), 1)
        release()
        press = zstandard.ZstdCompressor(level=1)
        blocks = [k for k in range(len(cells) // _BLOCK) if cells[k * _BLOCK : (k + 1) * _BLOCK].any()]
        data = [press.compress(cells[k * _BLOCK : (k + 1) * _BLOCK].tobytes()) for k in blocks]
        lot = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_arrays([pa.array([lot] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], names=["lot", "block", "cells"])

    def add(group):
        open_ = zstandard.ZstdDecompressor().decompress
        total = sum(np.frombuffer(open_(c), np.int64) for c in group["cells"])
        out = group.iloc[:1].copy()
        out["cells"] = [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]
        return out

    kinds = "lot int, block int, cells binary"
    parts = docs.select("text").mapInArrow(count, kinds)
    # Two levels, so that no group holds more than a few hundred blocks of 32 KB.
    lots = parts.groupBy("lot", "block").applyInPandas(add, kinds)
    whole = lots.withColumn("lot", F.lit(0)).groupBy("block").applyInPandas(add, kinds)
    out = np.zeros(1 << _CELL_BITS, np.int64)
    for r in whole.select("block", "cells").collect():
        found = zstandard.ZstdDecompressor().decompress(bytes(r.cells))
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(found, np.int64)
    return out


def _profiles(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per document: doc_id, n, sid (identity of its set), ranked prefix, histogram over ranges (written)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_frequencies(docs, n).astype(np.uint32))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows: list[tuple] = []
                for own in batch_sets(batch.column("text"), n):
                    size = len(own)
                    length = size - (percent * size + 99) // 100 + 1 if size else 0
                    ranks = counts[(own >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
                    order = np.lexsort((own, ranks))[:length]
                    ranges = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=_RANGES)
                    few = np.minimum(ranges, 32_767).astype(np.int16)
                    rows.append((size, set_id(own), own[order].view(np.int64), few))
                sizes, ids, prefixes, ranges = zip(*rows, strict=True)
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())]
                columns += [pa.array(prefixes, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sid", "prefix", "ranges"])
        release()

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, sid long, prefix array<long>, ranges array<short>"
    out = stash(docs.mapInArrow(profile, kinds), "jaccard-profiles")
    shared.destroy()
    return out


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, shingles) of the classes ``wanted`` (sid, label): scanned anew, picked by a bitmap (written)."""
    spark = docs.sparkSession

    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(1 << _BITMAP_BITS))

    bits = wanted.select(bucket("label").alias("b"))
    bits = bits.groupBy((F.col("b") / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")
    )
    words = np.zeros(1 << (_BITMAP_BITS - 6), np.int64)
    for r in bits.collect():  # at most 2**18 short rows
        words[r.word] = r.bits
    shared = spark.sparkContext.broadcast(words)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value.view(np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                b = np.array(batch.column("bucket_").to_pylist(), np.int64)
                keep = np.flatnonzero((held[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1))
                if not len(keep):
                    continue
                some = batch.take(pa.array(keep))
                found = list(batch_sets(some.column("text"), n))
                columns = [some.column("doc_id"), pa.array([set_id(x) for x in found], pa.int64())]
                columns.append(pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["label", "sid", "shingles"])
        release()

    rows = docs.where("doc_id IS NOT NULL").withColumn("bucket_", bucket("doc_id"))
    kinds = f"label {docs.schema['doc_id'].dataType.simpleString()}, sid long, shingles array<long>"
    found = rows.mapInArrow(compute, kinds)
    out = stash(found.join(wanted, ["label", "sid"], "left_semi").dropDuplicates(["sid"]).select("sid", "shingles"), "jaccard-sets")
    shared.destroy()
    return out


def _pair_filters(percent: int, first: bool) -> Column:
    """Length and positional filter for a pair met at a prefix shingle (columns na, pa, nb, pb).

    ``first``: a linked pair passes at its first common shingle; otherwise at any common shingle.
    """
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    most = most if first else most + F.least("pa", "pb")
    return (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & (
        (100 + percent) * most >= F.lit(percent) * (F.col("na") + F.col("nb"))
    )


class _Verifier:
    """Checks pairs of classes, each once, and keeps the sets it has computed."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> None:
        self.docs, self.classes, self.n, self.percent = docs, classes, n, percent
        self.sets: DataFrame | None = None
        self.seen: DataFrame | None = None
        self.links: DataFrame | None = None

    def check(self, met: DataFrame) -> bool:
        """Verify the pairs (a, b) of ``met`` that are new; whether any of them links."""
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.seen is not None:
            pairs = pairs.join(self.seen, ["a", "b"], "left_anti")
        pairs = stash(pairs, "jaccard-pairs")
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        shape = self.classes.select("sid", "n", "ranges")
        left = shape.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("ranges").alias("ra"))
        right = shape.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("ranges").alias("rb"))
        common = F.zip_with("ra", "rb", lambda x, y: F.least(x, y).cast("long"))
        bound = F.aggregate(common, F.lit(0).cast("long"), lambda s, x: s + x)
        bound = F.when(F.greatest("na", "nb") > _MOST_RANGED, F.least("na", "nb")).otherwise(bound)
        enough = (100 + self.percent) * bound >= F.lit(self.percent) * (F.col("na") + F.col("nb"))
        kept = pairs.join(left, "a").join(right, "b").where(enough).select("a", "b", "na", "nb")
        kept = stash(kept, "jaccard-suffix")

        ends = kept.select(F.col("a").alias("sid")).union(kept.select(F.col("b").alias("sid"))).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets, "sid", "left_anti")
        wanted = stash(self.classes.join(ends, "sid", "left_semi").select("label", "sid"), "jaccard-wanted")
        if not wanted.isEmpty():
            more = _sets(self.docs, wanted, self.n)
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return False
        a = self.sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        met = kept.join(b, "b").join(a, "a").select("a", "b", "na", "nb", both.alias("both"))
        union = F.col("na") + F.col("nb") - F.col("both")
        links = met.where(F.lit(100) * F.col("both") >= F.lit(self.percent) * union).select("a", "b")
        links = stash(links, "jaccard-links")
        drop_stash(kept)
        drop_stash(wanted)
        found = not links.isEmpty()
        if found:
            self.links = links if self.links is None else self.links.unionByName(links)
        return found

    def reach(self) -> DataFrame:
        """(sid, comp) of the classes that have a link so far."""
        if self.links is None:
            return local_table(self.docs.sparkSession, [], "sid long, comp long")
        found = components(self.links)
        out = stash(found.toDF("sid", "comp"), "jaccard-reach")
        drop_stash(found)
        return out

    def close(self) -> None:
        """Remove what the checks have written."""
        for df in (self.sets, self.seen, self.links):
            if df is not None:
                drop_stash(df)


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    """A list's rows as one side of a pair: a or b."""
    return df.select("h", F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id in reach by links) of every row.

    Two rows link when 100 * |intersection| >= percent * |union| for their sets of ``n``-word shingles.
    ``rounds`` bounds the rounds of stars; it changes the work left to the last step, not the result.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    profiles = _profiles(docs, n, percent)
    known = profiles.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("sid").agg(
        F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges")
    )
    classes = stash(classes, "jaccard-classes")
    members = stash(profiles.select("doc_id", "n", "sid"), "jaccard-members")
    drop_stash(profiles)

    # A list is led by the member that has the fewest rarer shingles before the list's: in a group of
    # edited copies that is the text nearest to the original, which most others link with.
    postings = classes.select("sid", "n", F.posexplode("prefix").alias("pos", "h"))
    turn = F.shiftleft(F.least("pos", F.lit(1 << 19)).cast("long"), 43).bitwiseOR(F.col("sid").bitwiseAND(F.lit((1 << 43) - 1)))
    leaders = postings.groupBy("h").agg(F.count("*").alias("members"), F.min(turn).alias("lead"))
    leaders = stash(leaders.where("members > 1").select("h", "lead"), "jaccard-leaders")
    live = postings.join(leaders, "h").select("h", "sid", "n", "pos", (turn == F.col("lead")).alias("leads"))
    live = stash(live, "jaccard-lists")
    drop_stash(leaders)

    verifier = _Verifier(docs, classes, n, percent)
    stars = _side(live.where("NOT leads"), "b").join(_side(live.where("leads"), "a"), "h")
    grew, left, last = verifier.check(stars.where(_pair_filters(percent, first=False))), live.where("NOT leads"), live
    for k in range(rounds):
        # Lists that still hold several components, and the one with most members in each.
        reach = verifier.reach()
        placed = left.select("h", "sid", "n", "pos").join(reach, "sid", "left")
        placed = stash(placed.withColumn("comp", F.coalesce("comp", "sid")), "jaccard-placed")
        drop_stash(reach)
        drop_stash(last)
        tally = placed.groupBy("h", "comp").agg(F.count("*").alias("members"))
        main = tally.groupBy("h").agg(F.max(F.struct("members", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
        left = last = stash(placed.join(main.where("comps > 1").select("h", "main"), "h"), "jaccard-mixed")
        drop_stash(placed)
        if not grew or k == rounds - 1:
            break
        # Everyone else against one member of the main component, another one in each round.
        draw = F.struct(F.xxhash64(F.lit(k), "sid").alias("draw"), "sid", "n", "pos")
        heads = left.where("comp = main").groupBy("h").agg(F.min(draw).alias("head")).select("h", "head.*")
        stars = _side(left.where("comp <> main"), "b").join(_side(heads, "a"), "h")
        grew = verifier.check(stars.where(_pair_filters(percent, first=False)))

    # What is left: all pairs of a list across its components, small components against all.
    x = _side(left.where("comp <> main"), "a", F.col("comp").alias("ca"))
    y = _side(left, "b", F.col("comp").alias("cb"), (F.col("comp") == F.col("main")).alias("in_main"))
    across = x.join(y, "h").where((F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") < F.col("b"))))
    verifier.check(across.where(_pair_filters(percent, first=True)))
    drop_stash(last)

    reach = verifier.reach()
    labels = classes.select("sid", "label").join(reach, "sid", "left")
    labels = stash(labels.select("sid", "label", F.coalesce("comp", "sid").alias("comp")), "jaccard-labels")
    smallest = labels.groupBy("comp").agg(F.min("label").alias("component_id"))
    named = labels.join(smallest, "comp").select("sid", "component_id")
    for df in (reach, classes):
        drop_stash(df)
    verifier.close()
    out = members.join(named, "sid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON p.u = r.v),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.u = s.doc_id
"""
