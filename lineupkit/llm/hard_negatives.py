"""Operator 13: hard negatives from inverted lists whose centroids and radii are stored.

K-means on a bounded sample gives the centroids of at most ``max_lists`` lists; every row joins the list of its nearest
centroid, and a list's radius is the largest distance of its rows.  By Cauchy and Schwarz no row of a list has an inner
product with an anchor a above a·c + |a| r, nor below a·c - |a| r.  An anchor visits lists by that upper bound, passes over
lists that lie outside its windows, and stops once the bound falls strictly below its k-th score.  Results are exact.

Lists live in shards, a list longer than ``list_rows`` in several.  Two rounds of visits: the first few lists of every
anchor, whose k-th scores then tell which others it has to ask; an anchor goes to a shard once, with the lists it visits there.
Positives are searched first (one window without bounds, own label, lists that hold that label), then the negatives, in one window a
positive.

Nulls and edge cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; zero and
empty vectors do; only vectors of one length meet; rows alike in vec_id, label and components count once, rows that share a
vec_id but differ are rows of their own (each asks, and a row is no candidate of its own alone), ties go to the smaller vec_id, then to the smaller label,
then by a hash of the components; a positive of negative score has an empty window; an empty table gives no rows; other columns are
ignored.  More than ``max_lengths`` vector lengths, or a score beyond a long, are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.llm.workers import release
from lineupkit.runtime import local_table, stash, table

_LOW, _HIGH = -(1 << 62), 1 << 62
_ASK = "id long, label long, e array<long>, lo array<long>, hi array<long>, least array<long>"
_VISIT = f"{_ASK}, shard int, lists array<int>, bounds array<double>"
_FOUND = "id long, slot int, node long, score long"


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each vector length."""
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    starts = np.cumsum(sizes) - sizes
    return [(rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)) for d in np.unique(sizes)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers held as float64: by doubles while these are exact, else by Python's integers."""
    largest = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


def k_means(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """Centroids of distinct starting rows, by Lloyd's rounds in blocks; an emptied list keeps its centroid."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_centre(sample, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - rows[at : at + 1024] @ centres.T).argmin(1) for at in range(0, len(rows), 1024)]) if len(rows) else np.zeros(0, np.int64)


class Lists:
    """What is known of all lists: by vector length the first list's number and the centroids; by list its radius, rows and shards."""

    def __init__(self, centres: dict[int, np.ndarray]) -> None:
        self.centres, self.first, n = centres, {}, 0
        for d in sorted(centres):
            self.first[d] = n
            n += len(centres[d])
        self.n, self.radius, self.parts, self.shard, self.shards = n, np.zeros(n), np.ones(n, int), np.zeros(n, int), 1

    def deal(self, sizes: dict[int, tuple[int, float]], list_rows: int, shards: int) -> None:
        """Radii, and shards: the fullest lists first, each to the shard with the fewest rows; the parts of one to shards in a row."""
        load, self.shards = np.zeros(shards), shards
        for k in sorted(sizes, key=lambda k: (-sizes[k][0], k)):
            rows, self.radius[k] = sizes[k]
            self.parts[k] = -(-rows // list_rows)
            self.shard[k] = at = int(load.argmin())
            load[(at + np.arange(self.parts[k])) % shards] += rows / self.parts[k]

    def bounds(self, d: int, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest inner product of each ask with a row of each list of this length."""
        c, at = self.centres[d], self.first[d]
        size, r = np.sqrt((asks * asks).sum(1))[:, None], self.radius[at : at + len(c)]
        mid = asks @ c.T
        wide = size * r + 1e-9 * (size * (np.sqrt((c * c).sum(1)) + r) + 1)
        return mid + wide, mid - wide


def _assign(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lists.value
        for batch in batches:
            own, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for rows, e in by_length(batch.column("e")):
                c = known.centres[e.shape[1]]
                k = nearest_centre(e, c)
                own[rows], far[rows] = known.first[e.shape[1]] + k, np.sqrt(((e - c[k]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far)], names=[*batch.schema.names, "list", "far"])

    return run


def _route(lists, seeds: int, again: bool):
    """Which lists each ask visits, best bound first: the first ``seeds``, or ``again`` the others its k-th scores leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lists.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 256):
                batch = whole.slice(cut, 256)
                lo, hi, least = (batch.column(c).to_pylist() for c in ("lo", "hi", "least"))
                holders = batch.column("holders").to_pylist()
                out: list[tuple] = []
                for rows, e in by_length(batch.column("e")):
                    if e.shape[1] not in known.centres:
                        continue
                    top, low = known.bounds(e.shape[1], e)
                    at = known.first[e.shape[1]]
                    for r, row in enumerate(rows.tolist()):
                        meets = lambda floors: np.any([(top[r] >= f) & (low[r] <= h) for f, h in zip(floors, hi[row], strict=True)], axis=0)  # noqa: B023, E731
                        order = np.argsort(-top[r], kind="stable")
                        some = meets(lo[row])
                        if holders[row] is not None:
                            held = np.zeros(known.n, bool)
                            held[holders[row]] = True
                            some &= held[at : at + len(some)]
                        order = order[some[order]]
                        visits = order[:seeds] if not again else order[seeds:][meets(least[row])[order[seeds:]]]
                        by_shard: dict[int, list[int]] = {}
                        for k in visits.tolist():
                            for s in sorted({int((known.shard[at + k] + p) % known.shards) for p in range(known.parts[at + k])}):
                                by_shard.setdefault(s, []).append(k)
                        out += [(row, s, [at + k for k in ks], top[r][ks].tolist()) for s, ks in by_shard.items()]
                if out:
                    row, shard, ks, tops = zip(*out, strict=True)
                    own = batch.drop_columns(["holders"]).take(pa.array(row))
                    more = [pa.array(shard, pa.int32()), pa.array(ks, pa.list_(pa.int32())), pa.array(tops, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "shard", "lists", "bounds"])

    return run


class _Shard:
    """The lists of a shard, each in order of vec_id."""

    def __init__(self, held: list[pa.RecordBatch], k: int, same: bool) -> None:
        self.k, self.same, self.lists = k, same, {}
        if held:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, node, label = (np.asarray(t.column(c), np.int64) for c in ("list", "id", "label"))
            for rows, e in by_length(t.column("e")):
                cuts = np.flatnonzero(np.diff(key[rows])) + 1
                for some, part in zip(np.split(rows, cuts), np.split(e, cuts), strict=True):
                    self.lists[int(key[some[0]])] = (node[some], label[some], part)

    def search(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, e in by_length(batch.column("e")):
            for at in range(0, len(rows), 256):
                yield from self._some(batch.take(pa.array(rows[at : at + 256])), e[at : at + 256])

    def _some(self, batch: pa.RecordBatch, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, ids, label = batch.num_rows, np.asarray(batch.column("id")), np.asarray(batch.column("label"))
        slots = max(map(len, lo := batch.column("lo").to_pylist()))
        window = lambda rows, fill: np.array([r + [fill] * (slots - len(r)) for r in rows], np.int64)
        lo, hi, least = window(lo, _HIGH), window(batch.column("hi").to_pylist(), _LOW), window(batch.column("least").to_pylist(), _HIGH)
        least = np.maximum(lo, least)
        lists, tops = batch.column("lists").to_pylist(), batch.column("bounds").to_pylist()
        found = [np.zeros((0, 3), np.int64)] * slots  # of each slot: row, score, place among all rows seen
        nodes: list[np.ndarray] = []
        base, alive = 0, np.arange(n)
        for wave in range(max(map(len, lists))):
            # Each ask's next list, while its bound is not strictly below the k-th score of every window.
            alive = np.array([r for r in alive if wave < len(lists[r]) and (tops[r][wave] >= least[r]).any()], int)
            for key in sorted({lists[r][wave] for r in alive}):
                if key not in self.lists:
                    continue
                node, labels, part = self.lists[key]
                asks = np.array([r for r in alive if lists[r][wave] == key])
                for at in range(0, len(node), 4096):
                    some = slice(at, at + 4096)
                    scores = products(e[asks], part[some])
                    fit = (labels[some] == label[asks][:, None]) == self.same
                    fit &= (node[some] != ids[asks][:, None]) & (scores >= least[asks].min(1)[:, None]) & (scores <= hi[asks].max(1)[:, None])
                    r, c = np.nonzero(fit)
                    new = np.column_stack([asks[r], scores[r, c], base + c])
                    nodes.append(node[some])
                    base += len(nodes[-1])
                    for s in range(slots):
                        inside = new[(new[:, 1] >= least[new[:, 0], s]) & (new[:, 1] <= hi[new[:, 0], s])]
                        if len(inside):
                            found[s] = self._best(np.concatenate([found[s], inside]), np.concatenate(nodes), least[:, s])
        out = [(np.full(len(f), s), f) for s, f in enumerate(found) if len(f)]
        if out:
            all_ = np.concatenate(nodes)
            slot, f = np.concatenate([s for s, _ in out]), np.concatenate([f for _, f in out])
            columns = [pa.array(ids[f[:, 0]]), pa.array(slot, pa.int32()), pa.array(all_[f[:, 2]]), pa.array(f[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "slot", "node", "score"])

    def _best(self, rows: np.ndarray, nodes: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first k of each ask, by score, then by node; raises the k-th scores that are full."""
        rows = rows[np.lexsort((nodes[rows[:, 2]], -rows[:, 1], rows[:, 0]))]
        begin = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(begin, np.arange(len(rows)), 0))
        last = rows[place == self.k - 1]
        least[last[:, 0]] = np.maximum(least[last[:, 0]], last[:, 1])
        return rows[place < self.k]


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for whole in batches:
            kinds = np.asarray(whole.column("asks"))
            cut = int(np.searchsorted(kinds, 1))
            if cut:
                held.append(whole.slice(0, cut).select(["id", "label", "e", "list"]))
            if cut < whole.num_rows:
                shard = shard or _Shard(held, k, same)
                held = []
                yield from shard.search(whole.slice(cut))
        release()

    return run


class _Index:
    """The table of rows with their lists, and what all tasks know of the lists."""

    def __init__(self, nodes: DataFrame, max_lists: int, sample_rows: int, sample_values: int, max_lengths: int, list_rows: int, shard_rows: int) -> None:
        self.spark = spark = nodes.sparkSession
        counts = {r.d: r.n for r in nodes.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).limit(max_lengths + 1).collect()}
        if len(counts) > max_lengths:
            raise ValueError(f"more than {max_lengths} vector lengths")
        self.rows, span = sum(counts.values()), 1 << 40
        wanted = {d: max(1, min(n, sample_rows * n // self.rows, sample_values // max(1, d))) for d, n in counts.items()}
        shares = local_table(spark, [(d, -(-span * wanted[d] // n) + 1) for d, n in counts.items()], "d long, share_ long")
        drawn = nodes.join(F.broadcast(shares), F.size("e") == F.col("d")).where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(span)) < F.col("share_"))
        sample = drawn.select("id", "e").toArrow().sort_by("id")
        found = by_length(sample.column("e").combine_chunks()) if sample.num_rows else []
        centres = {e.shape[1]: e for _, e in found}
        lists = Lists({
            d: k_means(centres[d], max(1, min(max_lists * n // self.rows, int(n**0.5)))) if d in centres else np.zeros((1, d))
            for d, n in counts.items()
        })
        first = spark.sparkContext.broadcast(lists)
        kept = stash(nodes.mapInArrow(_assign(first), "id long, vec_id long, label long, e array<long>, list int, far double"), "lists")
        first.destroy()
        sizes = {r.list: (r.n, r.far) for r in kept.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most max_lists
        lists.deal(sizes, list_rows, max(spark.sparkContext.defaultParallelism, -(-self.rows // shard_rows)))
        self.lists = spark.sparkContext.broadcast(lists)
        self.shards = lists.shards
        places = local_table(spark, [(k, int(lists.shard[k]), int(lists.parts[k])) for k in range(lists.n)], "k_ long, shard_ long, parts_ long")
        part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts_"))
        dealt = kept.join(F.broadcast(places), F.col("list") == F.col("k_"))
        self.kept = kept
        self.dealt = dealt.select("id", "label", "e", "list", ((F.col("shard_") + part) % self.shards).cast("int").alias("shard"))

    def search(self, asks: DataFrame, k: int, same: bool, seeds: int, again: bool) -> DataFrame:
        """(id, slot, node, score) of one round of visits."""
        visits = asks.select(*[x.split(" ")[0] for x in _ASK.split(", ")], "holders").mapInArrow(_route(self.lists, seeds, again), _VISIT)
        fields = [x.split(" ") for x in _VISIT.split(", ")]
        rows = self.dealt.select("id", "label", "e", "shard", "list", F.lit(0).alias("asks"), *[F.lit(None).cast(t).alias(n) for n, t in fields if n not in ("id", "label", "e", "shard")])
        both = rows.unionByName(visits.withColumns({"list": F.lit(-1), "asks": F.lit(1)}))
        dealt = both.repartitionById(self.shards, "shard").sortWithinPartitions("asks", F.size("e"), "list", "id")
        return dealt.mapInArrow(_search(k, same), _FOUND)

    def two_rounds(self, asks: DataFrame, k: int, same: bool, seeds: int) -> DataFrame:
        """The first ``k`` of every (id, slot).  ``asks``: id, label, e, holders and one (slot, lo, hi) array ``windows``."""
        order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "node")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        asks = stash(asks, "asks")
        arrays = [F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi")]
        own = ["id", "label", "e", "holders"]
        first = stash(best(self.search(asks.select(*own, *arrays, F.col("windows.lo").alias("least")), k, same, seeds, again=False)), "visited")
        full = first.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        asks = asks.join(full.withColumnRenamed("id", "i_"), F.col("id") == F.col("i_"), "left")
        least = F.transform("windows", lambda w: F.coalesce(F.try_element_at("kth", w["slot"]), w["lo"]))
        rest = self.search(asks.select(*own, *arrays, least.alias("least")), k, same, seeds, again=True)
        return stash(best(first.drop("rank").unionByName(rest)), "found")


def hard_negatives(
    vectors: DataFrame,
    asks: Column,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    scale: int = 256,
    seeds: int = 4,
    max_lists: int = 4_096,
    sample_rows: int = 65_536,
    sample_values: int = 8_000_000,
    max_lengths: int = 64,
    list_rows: int = 50_000,
    shard_rows: int = 200_000,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label) rows.

    Anchors are rows where ``asks`` (a condition on vec_id) holds; a component x counts as floor(scale x).  ``window``: percent
    of the positive's score between which a negative's lies.  K-means learns from ``sample_rows`` rows, at most ``sample_values`` components.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("e")).distinct()
    # Numbers that rise with vec_id, label and components, so that the smaller number wins a tie; fixed by being written.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = whole.repartitionByRange(tasks, "vec_id", "label", F.xxhash64("e")).sortWithinPartitions("vec_id", "label", F.xxhash64("e"), "e")
    nodes = stash(ordered.withColumn("id", F.monotonically_increasing_id()).select("id", "vec_id", "label", "e"), "vectors")
    if nodes.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = _Index(nodes, max_lists, sample_rows, sample_values, max_lengths, list_rows, shard_rows)
    slot = lambda n, lo, hi: F.struct(F.lit(n).cast("int").alias("slot"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))
    holders = index.kept.select("label", "list").distinct().groupBy(F.col("label").alias("l_")).agg(F.collect_list("list").alias("holders"))  # at most max_lists a label
    anchors = nodes.where(asks)
    first = anchors.join(holders, F.col("label") == F.col("l_")).select("id", "label", "e", "holders", F.array(slot(0, _LOW, _HIGH)).alias("windows"))
    near = index.two_rounds(first, positives, True, seeds)
    near = near.select("id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("node").alias("positive"), F.col("score").alias("positive_score"))
    # 100 n lies between 50 p and 95 p: whole bounds of n.
    lo, hi = F.ceil(F.col("positive_score") * F.lit(window[0]).cast("decimal(20,0)") / 100), F.floor(F.col("positive_score") * F.lit(window[1]).cast("decimal(20,0)") / 100)
    near = near.select("*", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo <= hi")
    windows = near.groupBy(F.col("id").alias("i_")).agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("windows"))  # at most ``positives`` each
    second = anchors.join(windows, F.col("id") == F.col("i_")).select("id", "label", "e", F.lit(None).cast("array<int>").alias("holders"), "windows")
    # Slots of an ask are counted from 0 in the order of its windows.
    second = second.withColumn("slots", F.col("windows.slot")).withColumn("windows", F.transform("windows", lambda w, k: F.struct(k.cast("int").alias("slot"), w["lo"].alias("lo"), w["hi"].alias("hi"))))
    hard = index.two_rounds(second.drop("slots"), negatives, False, seeds)
    counted = Window.partitionBy("id").orderBy("slot")
    near = near.withColumn("slot", (F.row_number().over(counted) - 1).cast("int"))
    name = lambda key, out: nodes.select(F.col("id").alias(key), F.col("vec_id").alias(out))
    out = hard.withColumnsRenamed({"node": "negative", "score": "negative_score"}).join(near.select("id", "slot", "positive", "positive_score"), ["id", "slot"])
    out = out.join(name("id", "anchor_id"), "id").join(name("positive", "positive_id"), "positive").join(name("negative", "negative_id"), "negative")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding among all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= 3"""
