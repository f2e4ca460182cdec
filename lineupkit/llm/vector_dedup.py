"""Operator 1: near-duplicate embeddings by navigable small-world graphs.

Equal vectors are one node with a multiplicity.  A small-world graph of pivots (nodes drawn by hash, at most
``max_pivots``, none linked with another) is the upper layer: every node searches it and hangs on its ``homes`` nearest
pivots.  Nodes that share a pivot meet in blocks, a pair where it shares its first one; so a node meets a few thousand
others, however many there are, until ``max_pivots`` is reached.  A pivot with many nodes is cut into tiles, and each pair
of tiles is a group of its own.  An audit holds the homes against brute force: a sample of nodes drawn by hash is compared
with all nodes, and every link of theirs must share a pivot; else four times the homes are taken.

Where that fails too, every node queries the graphs of all shards.  A query whose
beam is full of links is compared with the whole shard in blocks instead; and a
shard's beam is widened until an audit passes: against brute force over a sample of its
queries, drawn by hash, all links and nine tenths of the nearest vectors must be found.  A shard whose audit never
passes is compared by brute force in blocks as well.  Cosines of found
candidates are computed anew in double precision.  A task counts its links and keeps a spanning
forest of them in arrays, never the pairs; forests are united by connected components.

The number of shards is the parallelism at hand, or what ``shard_rows`` asks for: a shard of the graph
must fit a task.  Queries come in blocks of ``block_rows``.  The driver holds the pivots and the audit's sample of each vector
length, and the number of nodes of each pivot.

Nulls and edge cases: vectors that are null, zero or hold null or non-finite components link with
nothing and are components of their own; only vectors of equal length are compared; a null vec_id
takes no part (component null); rows that share a vec_id are vectors each of its own, linked or not by what they hold,
and get a result row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm.components import components
from lineupkit.llm.hnsw import Hnsw
from lineupkit.llm.vectors import against_shards, hashes, is_valid, matrix
from lineupkit.runtime import drop_stash, local_table, stash, table

_FOUND = "u long, v long, links long"
#: Single precision is off by less than this; what lies closer to the threshold is worked out anew.
_SLACK = 1e-4


def _found(u, v, links) -> pa.RecordBatch:
    columns = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v", "links"])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(1))[:, None]).astype(np.float32)


class _Layer(NamedTuple):
    """The upper layer for one vector length: its pivots' graph, their first number, and the audit's sample."""

    graph: Hnsw
    first: int
    homes: int
    ids: np.ndarray
    vectors: np.ndarray

    def hang(self, vectors: np.ndarray, beam: int) -> np.ndarray:
        """The pivots that vectors hang on, nearest first (-1: none)."""
        near, _ = self.graph.search(_unit(vectors), max(beam, 2 * self.homes))
        near = near[:, : self.homes]
        return np.where(near >= 0, near + self.first, -1)


def _apart(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors, without those linked with an earlier one: a dense group would spread over many pivots."""
    kept = np.zeros((0, vectors.shape[1]), np.float32)
    for at in range(0, len(vectors), 256):
        some = vectors[at : at + 256]
        some = some[~(some @ kept.T >= threshold).any(1)] if len(kept) else some
        near = np.tril(some @ some.T >= threshold, -1)
        free = np.ones(len(some), bool)
        for k in np.flatnonzero(near.any(1)):
            free[k] = not (near[k] & free).any()
        kept = np.concatenate([kept, some[free]])
    return kept


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of homes have one in common (-1 is none)."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 65_536):
        x, y = a[at : at + 65_536], b[at : at + 65_536]
        for k in range(x.shape[1]):
            out[at : at + 65_536] |= ((x[:, k : k + 1] == y) & (x[:, k : k + 1] >= 0)).any(1)
    return out


def _upper_layers(nodes: DataFrame, threshold: float, homes: int, audit: int, list_rows: int, max_pivots: int) -> dict[int, _Layer]:
    """By vector length: the graph of its pivots, and the sample that the audit asks about."""
    counts = {r.dim: r.n for r in nodes.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).collect()}
    wanted = {d: min(max_pivots, n * homes // list_rows) for d, n in counts.items()}
    wanted = {d: k if k > 2 * homes else 0 for d, k in wanted.items()}  # few nodes meet all in one place

    def drawn(salt: str, most: dict[int, int]) -> pa.Table:
        whole = 1 << 40
        share = F.create_map(*[F.lit(x) for d, k in most.items() for x in (d, min(whole, -(-whole * k // counts[d])))])
        place = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(whole))
        rows = nodes.select("id", "e", F.size("e").alias("dim"), place.alias("place")).where(F.col("place") < share[F.col("dim")])
        return rows.toArrow().sort_by([("place", "ascending"), ("id", "ascending")])

    if not counts:
        return {}
    pivots, sample = drawn("pivot", wanted), drawn("audit", dict.fromkeys(counts, audit))
    out, first = {}, 0
    for d in sorted(counts):
        some = pivots.filter(pc.equal(pivots["dim"], d)).combine_chunks()
        asked = sample.filter(pc.equal(sample["dim"], d)).combine_chunks()
        vectors = [matrix(x["e"].combine_chunks()) if x.num_rows else np.zeros((0, d)) for x in (some, asked)]
        apart = _apart(_unit(vectors[0]), threshold)
        graph = Hnsw(apart if len(apart) > homes else apart[:0])
        out[d] = _Layer(graph, first, homes, np.asarray(asked["id"].combine_chunks()), vectors[1])
        first += max(1, len(graph.x))
    return out


def _hung(nodes: DataFrame, layers: dict[int, _Layer], threshold: float, beam: int) -> DataFrame:
    """``nodes`` with their homes, and how many links with the audit's sample share none (written)."""
    asked = {d: layer.hang(layer.vectors, beam) if len(layer.ids) and len(layer.graph.x) else None for d, layer in layers.items()}
    shared = nodes.sparkSession.sparkContext.broadcast((layers, asked))

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, asked = shared.value
        for whole in batches:
            dims = np.asarray(pc.list_value_length(whole.column("e")))
            for d in np.unique(dims).tolist():
                batch, layer = whole.filter(pa.array(dims == d)), layers[d]
                ids, vectors = np.asarray(batch.column("id")), matrix(batch.column("e"))
                missed = np.zeros(len(ids), np.int64)
                if len(layer.graph.x):
                    homes = layer.hang(vectors, beam)
                else:
                    homes = np.full((len(ids), 1), layer.first, np.int64)
                if asked[d] is not None:
                    norms = [np.sqrt((x * x).sum(1)) for x in (vectors, layer.vectors)]
                    near = vectors @ layer.vectors.T / (norms[0][:, None] * norms[1]) >= threshold
                    row, q = np.nonzero(near & (ids[:, None] != layer.ids))
                    missed = np.bincount(row[~_share(homes[row], asked[d][q])], minlength=len(ids))
                columns = [*batch.columns, pa.array(list(homes), pa.list_(pa.int64())), pa.array(missed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "homes", "missed"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    out = stash(nodes.mapInArrow(hang, f"{kinds}, homes array<long>, missed long"), "vector-homes")
    shared.destroy()
    return out


class _Meeting:
    """Nodes of one pivot, or of two of its tiles, compared in blocks: links counted, a spanning forest kept."""

    def __init__(self, rows: pa.Table, home: int, threshold: float) -> None:
        self.home, self.threshold = home, threshold
        self.ids, self.weight = np.asarray(rows["id"].combine_chunks()), np.asarray(rows["n"].combine_chunks())
        self.vectors = matrix(rows["e"].combine_chunks())
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        homes = matrix(rows["homes"].combine_chunks()).astype(np.int64)
        self.earlier = np.where(homes < home, homes, -1)
        self.links = np.zeros(len(self.ids))
        self.parent = np.arange(len(self.ids))
        self.edges: list[np.ndarray] = []

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of ``left`` and ``right`` (places of rows); where they are the same, each pair once."""
        alike = left is right
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            sims = self.unit[some] @ self.unit[right].T
            if sims.max(initial=-2) < self.threshold - _SLACK and not alike:
                continue
            r, c = np.nonzero(sims >= self.threshold - _SLACK)
            if alike:
                later = c > r + at
                r, c = r[later], c[later]
            a, b = some[r], right[c]
            unsure = np.flatnonzero(sims[r, c] < self.threshold + _SLACK)
            if len(unsure):
                u, v = a[unsure], b[unsure]
                dots = (self.vectors[u] * self.vectors[v]).sum(1)
                good = np.ones(len(a), bool)
                good[unsure] = dots / (self.norms[u] * self.norms[v]) >= self.threshold
                a, b = a[good], b[good]
            if len(a):
                own = ~_share(self.earlier[a], self.earlier[b])  # the pair meets at its first common pivot alone
                self._add(a[own], b[own])

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.ids)
        self.links += np.bincount(a, self.weight[b], n) + np.bincount(b, self.weight[a], n)
        while True:
            while ((up := self.parent[self.parent]) != self.parent).any():
                self.parent = up
            x, y = self.parent[a], self.parent[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            heads, pick = np.unique(high, return_index=True)
            self.parent[heads] = low[pick]
            self.edges.append(np.column_stack([self.ids[a[pick]], self.ids[b[pick]]]))

    def rows(self) -> pa.Table:
        some = np.flatnonzero(self.links)
        edges = np.concatenate([np.zeros((0, 2), np.int64), *self.edges])
        counted = _found(self.ids[some], [None] * len(some), self.links[some].astype(np.int64))
        return pa.Table.from_batches([counted, _found(edges[:, 0], edges[:, 1], np.zeros(len(edges), np.int64))])


def _met(hung: DataFrame, small: str, threshold: float, tile_rows: int) -> DataFrame:
    """Links and forests (``_FOUND``) of all pivots' nodes."""
    each = hung.select("id", "n", F.col("e").cast(small).alias("e"), "homes", F.explode("homes").alias("home")).where("home >= 0")
    sizes = each.groupBy("home").agg(F.count("*").alias("rows")).where(F.col("rows") > tile_rows).collect()
    # At most one short row a pivot: a proven bound for the broadcast.
    cut = local_table(hung.sparkSession, [(r.home, -(-r.rows // tile_rows)) for r in sizes], "home long, tiles long")
    each = each.join(F.broadcast(cut), "home", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    each = each.withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "id"), "tiles"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    each = each.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        home, low, high = (k.as_py() for k in key)
        meeting = _Meeting(rows, home, threshold)
        tile = np.asarray(rows["tile"].combine_chunks())
        left = np.flatnonzero(tile == low)
        meeting.compare(left, left if low == high else np.flatnonzero(tile == high))
        return meeting.rows()

    return each.select("home", "low", "high", "tile", "id", "n", "e", "homes").groupBy("home", "low", "high").applyInArrow(meet, _FOUND)


class _Search:
    """One shard's graph and the links found from it."""

    def __init__(self, shard: pa.Table | None, threshold: float, beam: int, audit: int) -> None:
        self.threshold, self.beam, self.audit = threshold, beam, audit
        self.audited = self.exact = False
        self.edges: list[np.ndarray] = []  # (query, vector) ids
        self.graph = None
        if shard is not None:
            self.ids = np.asarray(shard.column("id").combine_chunks())
            self.weight = np.asarray(shard.column("n").combine_chunks())
            self.vectors = matrix(shard.column("e").combine_chunks())
            self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
            self.graph = Hnsw(self.vectors / self.norms[:, None])
            self.by_id = np.argsort(self.ids)
            self.parent = np.arange(len(self.ids))  # of the shard's vectors, as united so far

    def _roots(self, node: np.ndarray) -> np.ndarray:
        """Roots of an array of vectors; paths are shortened."""
        root = self.parent[node]
        while ((up := self.parent[root]) != root).any():
            root = up
        self.parent[node] = root
        return root

    def _widen(self, unit: np.ndarray) -> None:
        """The audit: a sample of queries by brute force, in blocks."""
        sample = unit[: self.audit].astype(np.float32)
        inner, top = [], np.zeros(len(sample), np.float32)
        for at in range(0, len(sample), 32):  # 32 queries against a shard: a few tens of MB at most
            sims = sample[at : at + 32] @ self.graph.x.T
            inner += [np.flatnonzero(row >= self.threshold) for row in sims]
            top[at : at + 32] = sims.max(1)
        while self.beam < len(self.ids):
            ids, sims = self.graph.search(sample, self.beam)
            open_end = sims[:, -1] >= self.threshold  # widened query by query later
            missed = any(not np.isin(want, got).all() for want, got, more in zip(inner, ids, open_end, strict=True) if not more)
            nearest = (sims[:, 0] >= top - 1e-5).mean()
            if not missed and nearest >= 0.9:
                break
            self.beam *= 2
        else:
            self.exact = True
        self.audited = True

    def _count(self, links: np.ndarray, ids: np.ndarray, row: np.ndarray, node: np.ndarray) -> None:
        """Add links between queries ``row`` and vectors ``node`` of the shard; of each query one edge a component that it meets."""
        if not len(row):
            return
        links += np.bincount(row, self.weight[node], len(links)).astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, node = row[order], node[order]
        place = np.minimum(np.searchsorted(self.ids[self.by_id], ids), len(self.ids) - 1)
        own = np.where(self.ids[self.by_id[place]] == ids, self.by_id[place], -1)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for q, met in zip(row[np.r_[0, cuts]], np.split(node, cuts), strict=True):
            roots, at = np.unique(self._roots(met), return_index=True)
            here = int(own[q])
            if here >= 0:  # the query is a vector of this shard: what it is united with already needs no edge
                root = self._roots(np.array([here]))[0]
                roots, at = roots[roots != root], at[roots != root]
            else:
                root = roots[0]
            self.parent[roots] = root
            self.edges.append(np.column_stack([np.full(len(at), ids[q]), self.ids[met[at]]]))

    def _compare(self, links: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, todo: np.ndarray) -> None:
        """The queries ``todo`` against every vector of the shard, in blocks."""
        for at in range(0, len(self.ids), 2048):
            some = slice(at, at + 2048)
            cosines = vectors[todo] @ self.vectors[some].T / (norms[todo][:, None] * self.norms[some])
            r, c = np.nonzero((cosines >= self.threshold) & (self.ids[some] != ids[todo][:, None]))
            self._count(links, ids, todo[r], at + c)

    def __call__(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if batch is None:
            edges = np.concatenate([np.zeros((0, 2), np.int64), *self.edges])
            yield _found(edges[:, 0], edges[:, 1], np.zeros(len(edges), np.int64))
            return
        if self.graph is None:
            return
        ids, vectors = np.asarray(batch.column("id")), matrix(batch.column("e"))
        norms = np.sqrt((vectors * vectors).sum(1))
        unit = vectors / norms[:, None]
        if not self.audited:
            self._widen(unit)
        links = np.zeros(len(ids), np.int64)
        todo, slack = np.arange(len(ids)), 1e-4
        if not self.exact and self.beam < len(self.ids):
            near, sims = self.graph.search(unit, self.beam)
            full = sims[:, -1] >= self.threshold - slack
            row, c = np.nonzero((sims >= self.threshold - slack) & ~full[:, None])
            node = near[row, c]
            dots = (vectors[row] * self.vectors[node]).sum(1)
            good = (dots / (norms[row] * self.norms[node]) >= self.threshold) & (self.ids[node] != ids[row])
            self._count(links, ids, row[good], node[good])
            todo = todo[full]
        # A beam that is full of links may miss some: such a query meets every vector of the shard, in blocks.
        if len(todo):
            self._compare(links, ids, vectors, norms, todo)
        yield _found(ids, [None] * len(ids), links)


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    beam: int = 64,
    audit: int = 256,
    shard_rows: int = 200_000,
    block_rows: int = 1_000_000,
    homes: int = 8,
    list_rows: int = 1_024,
    max_pivots: int = 16_384,
    tile_rows: int = 4_096,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    ``list_rows`` is how many nodes a pivot has on average, while there are fewer than ``max_pivots``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("vec_id").isNotNull() & is_valid(F.col("e"))
    keyed = rows.select("vec_id", "e", usable.alias("usable_"), *hashes(F.col("e")))
    nodes = keyed.where("usable_").groupBy("ha_", "hb_").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("e").alias("e"))
    # A number of its own for every distinct vector, fixed by being written.
    nodes = stash(nodes.withColumn("id", F.monotonically_increasing_id()), "vector-nodes")
    both = nodes.select("id", "e", "n")
    kind = vectors.schema["embedding"].dataType.simpleString()
    found = None
    for more in (homes, 4 * homes):
        hung = _hung(both, _upper_layers(both, threshold, more, audit, list_rows, max_pivots), threshold, beam)
        if not hung.agg(F.sum("missed")).first()[0]:
            found = stash(_met(hung, kind if kind == "array<float>" else "array<double>", threshold, tile_rows), "vector-links")
            drop_stash(hung)
            break
        drop_stash(hung)
    if found is None:
        count = nodes.count()
        shards = max(spark.sparkContext.defaultParallelism, -(-count // shard_rows))
        blocks = max(1, -(-count // block_rows))
        found = stash(against_shards(both, both, shards, blocks, lambda s: _Search(s, threshold, beam, audit), _FOUND), "vector-links")

    reach = components(found.where("v IS NOT NULL").select("u", "v"))
    links = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("links"))
    joined = nodes.select("ha_", "hb_", "id", "n", "low").join(links, F.col("id") == F.col("u"), "left")
    joined = joined.join(reach, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    joined = joined.join(least, "component").select("ha_", "hb_", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = keyed.where(~F.col("usable_")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    known = keyed.where("usable_").select("vec_id", "ha_", "hb_").join(joined, ["ha_", "hb_"])
    out = known.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, p.w FROM r JOIN p ON p.u = r.w),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT c.u AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.u = component_id AS kept
FROM c LEFT JOIN n ON n.u = c.u
"""
