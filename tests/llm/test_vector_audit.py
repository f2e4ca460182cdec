"""The audit of op1_hnsw_dedup: an exact way when it fails, a random sample, reverse links by nearness."""

import time

import numpy as np
import pyarrow as pa
from lineupkit.llm.hnsw import Hnsw
from lineupkit.llm.vector_dedup import _Search
from lineupkit.llm.vectors import against_shards


def test_unreachable_vectors_are_found():
    rng = np.random.default_rng(2)
    x = rng.normal(size=8) + rng.normal(size=(600, 8)) * 0.2
    x[300:] = rng.normal(size=8) + rng.normal(size=(300, 8)) * 0.2
    shard = pa.table({"id": np.arange(600), "n": np.ones(600, np.int64), "e": pa.array(x.tolist(), pa.list_(pa.float64()))})
    search = _Search(shard, 0.9, 64, 256)
    # No link leads to every third vector.
    for links in search.graph.links:
        links[links % 3 == 1] = -1
    batches = shard.to_batches()[0]
    got = [b for at in range(0, 600, 256) for b in search(batches.slice(at, 256))]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert np.concatenate([b.column("links").to_numpy() for b in got]).tolist() == want.tolist()


def test_reverse_links_take_the_nearest():
    angles = np.linspace(1.5, 0.01, 400)
    x = np.float32([[1, 0], *np.stack([np.cos(angles), np.sin(angles)], 1)])
    graph = Hnsw(x)
    graph.links[0][:] = -1
    new = np.arange(1, 401)
    graph._link(0, new, np.zeros((400, 1), np.int64), (x[new] @ x[0])[:, None])
    assert 400 in graph.links[0][0]


def test_first_batch_is_a_random_sample(spark):
    rows = spark.range(0, 2000).selectExpr("id", "array(1D, CAST(id AS DOUBLE)) AS e")

    def work(shard):
        calls = []

        def ask(batch):
            if batch is not None:
                ids = batch.column("id").to_pylist()
                calls.append(len(ids))
                if len(calls) == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([max(ids)])], names=["n", "most"])

        return ask

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        got = against_shards(rows, rows, 2, 1, work, "n long, most long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert [r.n for r in got] == [256, 256] and all(r.most > 1500 for r in got)


def test_thousands_of_near_equal_vectors_in_one_shard():
    """5,000 near-equal vectors and 1,500 others: the links and components of brute force, within seconds."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=24) + 0.02 * rng.normal(size=(5000, 24)), rng.normal(size=(1500, 24))])
    ids = rng.permutation(len(x)) * 3 + 1
    table = pa.table({"id": ids, "n": np.ones(len(x), np.int64), "e": list(x)})
    began = time.time()
    search = _Search(table, 0.9, 64, 64)
    found, edges = {}, []
    order = rng.permutation(len(x))
    for at in range(0, len(x), 256):
        part = table.take(pa.array(order[at : at + 256])).combine_chunks().to_batches()[0]
        for batch in search(part):
            found |= dict(zip(batch.column("u").to_pylist(), batch.column("links").to_pylist(), strict=True))
    for batch in search(None):
        edges = list(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True))
    took = time.time() - began
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    assert found == dict(zip(ids.tolist(), linked.sum(1).tolist(), strict=True))
    parent = {int(i): int(i) for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len(edges) < 2 * len(x)
    group = {root(int(i)) for i, k in zip(ids, linked.sum(1), strict=True) if k > 4000}
    assert len(group) == 1 and sum(root(int(i)) in group for i in ids) == 5000
    assert took < 60
