"""Communities, average linkage and ego networks against plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from lineupkit.operators import graphs


def planted(seed=3, n=24):
    """Three groups with heavy edges inside."""
    rng = np.random.default_rng(seed)
    names = [f"n{k:02d}" for k in range(n)]
    return [(names[a], names[b], float(rng.uniform(0.5, 2) if a % 3 == b % 3 else rng.uniform(0.01, 0.6))) for a in range(n) for b in range(a + 1, n) if a % 3 == b % 3 or rng.random() < 0.4]


def plain_communities(edges, scale=1_000_000, least=1e-3, rounds=30):
    w = {(a, b): round(x * scale) for a, b, x in edges}
    total, member, levels = sum(w.values()), {n: n for a, b, _ in edges for n in (a, b)}, []
    loops = defaultdict(int)
    for level in range(20):
        k, near = defaultdict(int), defaultdict(dict)
        for (a, b), x in w.items():
            k[a] += x
            k[b] += x
            near[a][b] = near[b][a] = x
        for a, x in loops.items():
            k[a] += 2 * x
        comm = {n: n for n in k}

        def quality(comm):
            inside, d = sum(x for (a, b), x in w.items() if comm[a] == comm[b]) + sum(loops.values()), defaultdict(int)  # noqa: B023
            for n, c in comm.items():
                d[c] += k[n]  # noqa: B023
            return 4 * total * inside - sum(x * x for x in d.values())

        now = first = quality(comm)
        idle = 0
        for turn in range(rounds):
            if idle == 2:
                break
            d, asked = defaultdict(int), []
            for n, c in comm.items():
                d[c] += k[n]
            for n in k:
                if zlib.crc32(f"{level}:{n}".encode()) % 2 != turn % 2:
                    continue
                met = defaultdict(int, {comm[n]: 0})
                for v, x in near[n].items():
                    met[comm[v]] += x
                gain = {c: x * 2 * total - k[n] * (d[c] - (k[n] if c == comm[n] else 0)) for c, x in met.items()}
                best = min(gain, key=lambda c: (-gain[c], c))  # noqa: B023
                if gain[best] > gain[comm[n]]:
                    asked.append((gain[comm[n]] - gain[best], n, comm[n], best))
            new = comm | {n: to for _, n, _, to in asked}
            if asked and quality(new) <= now:
                top = {}
                for g, n, a, b in sorted(asked):
                    top.setdefault(a, n)
                    top.setdefault(b, n)
                new = comm | {n: b for g, n, a, b in asked if top[a] == top[b] == n}
            better = quality(new)
            assert better >= now
            idle = 0 if better - now > least * 4 * total * total else idle + 1
            comm, now = new, better
        levels.append(now / (4 * total * total))
        if now - first <= least * 4 * total * total:
            break
        name = {c: min(n for n in comm if comm[n] == c) for c in comm.values()}
        comm = {n: name[c] for n, c in comm.items()}
        member = {n: comm[c] for n, c in member.items()}
        up, inner = defaultdict(int), defaultdict(int)
        for a, x in loops.items():
            inner[comm[a]] += x
        for (a, b), x in w.items():
            if comm[a] == comm[b]:
                inner[comm[a]] += x
            else:
                up[min(comm[a], comm[b]), max(comm[a], comm[b])] += x
        w, loops = dict(up), inner
    return member, levels


@pytest.mark.parametrize("seed", [3, 4])
def test_communities_equal_the_plain_rule(spark, seed):
    edges = planted(seed)
    member, levels = graphs.communities(spark.createDataFrame(edges, "i string, j string, weight double").repartition(3))
    want, want_levels = plain_communities(edges)
    assert {r.node: r.community for r in member.collect()} == want
    assert levels == pytest.approx(want_levels, abs=1e-12) and levels == sorted(levels)
    assert len(set(want.values())) == 3


def test_communities_of_nothing(spark):
    edges = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.0)], "i string, j string, weight double")
    member, levels = graphs.communities(edges)
    assert member.count() == 0 and levels == []


def plain_linkage(d):
    """Average linkage, one merge at a time."""
    clusters, out = {n: [n] for p in d for n in p}, []
    far = lambda a, b: sum(d[min(x, y), max(x, y)] for x in clusters[a] for y in clusters[b]) / len(clusters[a]) / len(clusters[b])
    while len(clusters) > 1:
        h, a, b = min((far(a, b), a, b) for a in clusters for b in clusters if a < b)
        out.append((a, b, h, len(clusters[a]) + len(clusters[b])))
        clusters[a] += clusters.pop(b)
    return sorted(out), next(iter(clusters.values()))


def test_linkage_equals_one_merge_at_a_time(spark):
    rng = np.random.default_rng(5)
    names = [f"f{k:02d}" for k in range(17)]
    d = {(a, b): float(rng.random()) for k, a in enumerate(names) for b in names[k + 1 :]}
    merges, leaves = graphs.average_linkage(spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "i string, j string, distance double"))
    want, order = plain_linkage(d)
    got = sorted(tuple(r) for r in merges.collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    assert [r.node for r in leaves.orderBy("position").collect()] == order


def test_linkage_with_ties_and_without_pairs(spark):
    one = spark.createDataFrame([(a, b, 1.0) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))], "i string, j string, distance double")
    merges, leaves = graphs.average_linkage(one)
    assert sorted((r.a, r.b, r.height, r["size"]) for r in merges.collect()) == [("a", "b", 1.0, 2), ("a", "c", 1.0, 3)]
    assert [r.node for r in leaves.orderBy("position").collect()] == ["a", "b", "c"]
    merges, leaves = graphs.average_linkage(one.limit(0))
    assert merges.count() == leaves.count() == 0


def test_profile_distances(spark):
    rows = [("a", "c", 1.0), ("b", "c", 2.0), ("a", "d", -1.0), ("e", "f", 1.0)]
    got = {(r.i, r.j): r.distance for r in graphs.profile_distances(spark.createDataFrame(rows, "i string, j string, coupling double")).collect()}
    assert len(got) == 15 and got["a", "b"] == pytest.approx(1 - 1 / np.sqrt(2)) and got["a", "e"] == 1 and got["c", "d"] == pytest.approx(1 + 1 / np.sqrt(5))
