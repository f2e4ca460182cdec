"""The vector operators against brute force."""

import numpy as np
from lineupkit.llm.hnsw import Hnsw
from lineupkit.llm.vector_dedup import near_vectors
from lineupkit.llm.vector_search import nearest
from pyspark.sql import functions as F

KINDS = "vec_id long, embedding array<float>, n int, e string"


def table(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    cloud = base[0] + rng.normal(size=(120, 16)) * 0.05
    chain = [np.cos(a) * base[1] / np.linalg.norm(base[1]) + np.sin(a) * base[2] / np.linalg.norm(base[2]) for a in np.linspace(0, 1.2, 8)]
    vectors = [*base, *cloud, *chain, *[base[3]] * 40, *[base[3] * 2] * 5]
    rows = [(k, [float(x) for x in np.float32(v)], 1, "x") for k, v in enumerate(vectors)]
    rng.shuffle(rows)
    n = len(rows)
    rows += [(n, None, 1, ""), (n + 1, [0.0] * 16, 1, ""), (n + 2, [float("nan")] * 16, 1, ""), (n + 3, [None] * 16, 1, ""), (n + 4, [float("inf")] + [0.0] * 15, 1, "")]
    rows += [(None, rows[0][1], 1, ""), (n + 5, [1.0, 2.0], 1, ""), (n + 6, [2.0, 4.0], 1, ""), (n + 7, [], 1, "")]
    return rows, spark.createDataFrame([(r[0] if r[0] is None else int(r[0]), r[1], r[2], r[3]) for r in rows], KINDS).repartition(5)


def cosines(rows):
    usable = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and r[1] and None not in r[1]]
    usable = [(k, v) for k, v in usable if np.isfinite(v).all() and (v**2).sum() > 0]
    out = {}
    for a, u in usable:
        for b, v in usable:
            if len(u) == len(v):
                out[int(a), int(b)] = u @ v / np.sqrt((u @ u) * (v @ v))
    return out


def test_near_vectors(spark):
    rows, df = table(spark)
    sims = cosines(rows)
    up = {int(r[0]): int(r[0]) for r in rows if r[0] is not None}
    links = dict.fromkeys(up, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), s in sims.items():
        if a != b and s >= 0.9:
            links[a] += 1
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = near_vectors(df, beam=8, audit=32).collect()
    assert len(got) == len(rows)
    known = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None}
    assert known == {k: (links[k], root(k), root(k) == k) for k in up}
    assert near_vectors(df.limit(0)).count() == 0


def test_nearest(spark):
    rows, df = table(spark)
    sims = cosines(rows)
    asked = sorted({a for a, _ in sims if a % 7 == 0})
    got = nearest(df, F.col("vec_id") % 7 == 0, k=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in asked:
        want = sorted((-s, b) for (a, b), s in sims.items() if a == q and b != q)[:5]
        found = sorted(by.get(q, []))
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert all(abs(s - sims[q, v]) < 1e-12 for _, v, s in found)
        hits, total = hits + len({v for _, v, _ in found} & {b for _, b in want}), total + len(want)
    assert hits / total >= 0.9 and set(by) == {q for q in asked if any(a == q and b != q for a, b in sims)}
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw(x)
    q = x[:200] + rng.normal(size=(200, 32)).astype(np.float32) * 0.1
    ids, _ = graph.search(q, 96)
    best = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, best, strict=True)]) > 0.9
    assert Hnsw(x[:1]).search(q[:2], 4)[0][:, 0].tolist() == [0, 0]
    assert (Hnsw(np.zeros((0, 32))).search(q[:2], 4)[0] == -1).all()


def test_repeated_ids(spark):
    """Rows that share a vec_id are vectors of their own; a search names an id once."""
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, c), (2, b), (3, c)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, near_vectors(df).collect()))
    assert got == [(1, 3, 1, True)] * 3 + [(2, 1, 2, True), (2, 3, 1, False), (3, 1, 2, False)]
    found = sorted(map(tuple, nearest(df, F.col("vec_id") == 1, k=2).select("query_id", "rank", "vec_id").collect()))
    assert found == [(1, 1, 2), (1, 2, 3)]


def regions(n, seed):
    """A few tight groups, an even cloud and a line: regions that are unlike in how hard they are to search."""
    rng = np.random.default_rng(seed)
    tight = rng.normal(size=(8, 32)).repeat(n // 32, 0) + rng.normal(size=(n // 4, 32)) * 0.15
    line = np.linspace(0, 1, n // 4)[:, None] * rng.normal(size=32) + rng.normal(size=(n // 4, 32)) * 0.3
    return np.concatenate([tight, line, rng.normal(size=(n - len(tight) - len(line), 32))]).astype(np.float32).astype(float)


def test_many_rows_in_few_shards(spark):
    x = regions(20_000, 3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 20_000, 40)
    sims = unit[asked] @ unit.T
    sims[np.arange(len(asked)), asked] = -2
    want = np.argsort(-sims, 1)[:, :5]
    found = {}
    for r in nearest(df, F.col("vec_id") % 40 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = np.array([len(found[int(q)] & set(w.tolist())) / 5 for q, w in zip(asked, want, strict=True)])
    assert hits.mean() >= 0.95 and min(hits[:125].mean(), hits[125:250].mean(), hits[250:].mean()) >= 0.9
    got = {r.vec_id: r.n_links for r in near_vectors(df.where("vec_id % 4 = 0"), beam=16).collect()}
    own = unit[::4]
    links = np.concatenate([(own[k : k + 1000] @ own.T >= 0.9).sum(1) for k in range(0, len(own), 1000)]) - 1
    assert sum(got[4 * k] for k in range(len(own))) >= 0.999 * links.sum() and all(got[4 * k] <= n for k, n in enumerate(links.tolist()))


def test_op1_equals_sql(spark, duck):
    from lineupkit.llm.queries import QUERIES, SQL

    got = sorted(map(tuple, QUERIES["op1_hnsw_dedup"](spark, "/root/testdata/sf0.001").select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted(duck.sql(SQL["op1_hnsw_dedup"]).fetchall())


def test_nodes_meet_only_those_of_their_pivots(spark, monkeypatch):
    """Links of an even cloud, of its near copies and of a dense group cut into tiles, without asking every shard."""
    from lineupkit.llm import vector_dedup

    def asked(*_):
        raise AssertionError("every vector asks every shard")

    monkeypatch.setattr(vector_dedup, "against_shards", asked)
    rng = np.random.default_rng(6)
    even = rng.normal(size=(4000, 48))
    copies = even[:800].repeat(2, 0) + rng.normal(size=(1600, 48)) * 0.1
    dense = rng.normal(size=48) + rng.normal(size=(1400, 48)) * 0.1
    x = np.concatenate([even, copies, dense]).astype(np.float32).astype(float)
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, list_rows=256, tile_rows=500).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    first = np.arange(len(x))
    while ((low := np.where(linked, first, len(x)).min(1)) != first).any():
        first = low
    assert got == {k: (n - 1, c) for k, (n, c) in enumerate(zip(linked.sum(1).tolist(), first.tolist(), strict=True))}
