"""Match agreement with its null, mean-field ranks and overlaps against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineupkit.operators import completion, outcomes


def _icc(keys, y):
    groups = {}
    for k, v in zip(keys, y, strict=True):
        groups.setdefault(k, []).append(v)
    groups = [np.array(g, float) for g in groups.values() if len(g) >= 2]
    n, g = sum(map(len, groups)), len(groups)
    if g < 2 or n == g:
        return None
    mean = np.concatenate(groups).mean()
    between = sum(len(x) * (x.mean() - mean) ** 2 for x in groups) / (g - 1)
    within = sum(((x - x.mean()) ** 2).sum() for x in groups) / (n - g)
    k0 = (n - sum(len(x) ** 2 for x in groups) / n) / (g - 1)
    below = between + (k0 - 1) * within
    return (between - within) / below if below > 1e-12 else None


def test_match_icc_against_plain_python(spark):
    rng = np.random.default_rng(5)
    matches = [(m, int(rng.integers(1, 4)), *(f"k{rng.integers(0, 9) if rng.random() < 0.7 else 0}" for _ in range(2))) for m in range(200)]
    sides = [(m, r, key, won) for m, r, a, b in matches for key, won in ((a, True), (b, False))]
    frame = spark.createDataFrame([*sides, (None, 1, "k1", True), (999, 1, None, True)], "match_id long, round int, key string, won boolean")
    slices = {"all": F.lit(True), "first": F.col("round") == 1, "none": F.col("round") > 9}
    got = {r["slice"]: r for r in outcomes.match_icc(frame, slices, 6).collect()}
    assert set(got) == {"all", "first"}
    for name, rounds in (("all", {1, 2, 3}), ("first", {1})):
        some = [s for s in sides if s[1] in rounds]
        runs = []
        for rep in range(7):
            flip = lambda m: rep > 0 and hashlib.md5(f"{rep}|{m}".encode()).hexdigest()[0] < "8"  # noqa: B023, E731
            runs.append(_icc([k for _, _, k, _ in some], [won != flip(m) for m, _, _, won in some]))
        null = np.array(runs[1:])
        row = got[name]
        assert row.matches == len(some) // 2 and row.icc == pytest.approx(runs[0])
        assert (row.null_mean, row.null_sd) == (pytest.approx(null.mean()), pytest.approx(null.std()))
        assert row.excess == pytest.approx((runs[0] - null.mean()) / null.std())
    assert outcomes.match_icc(frame, slices, 2, 100).where("slice = 'first'").count() == (len([m for m in matches if m[1] == 1]) >= 100)
    alone = outcomes.match_icc(frame.where("match_id = 1 AND won"), slices, 2)
    assert alone.count() == 0  # no group of two sides
    assert outcomes.match_icc(frame.where("false"), slices, 2).count() == 0


def test_played_pairs_contingency_and_sites(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "team_id long, feature string")
    sides = spark.createDataFrame([(1, 1, 1, True), (1, 1, 2, False), (2, 2, 2, True), (2, 2, 3, False)], "match_id long, round int, team_id long, won boolean")
    assert sorted(map(tuple, outcomes.played_pairs(members, sides).collect())) == [("a", "b", 3), ("a", "c", 2), ("b", "c", 2)]
    wide = outcomes.contingency(members, "team_id", "feature").orderBy("team_id")
    assert wide.columns == ["team_id", "a", "b", "c"] and [tuple(r) for r in wide.collect()] == [(1, 1, 1, 0), (2, 1, 1, 1), (3, 0, 0, 1)]
    with pytest.raises(ValueError, match="columns"):
        outcomes.contingency(members, "team_id", "feature", 2)
    pairs = spark.createDataFrame([(1, "s", "s1"), (1, "s", "s2"), (2, "s", "s1"), (3, "s", "s1"), (3, "t", "t1")], "team_id long, species string, feature string")
    got = sorted(map(tuple, outcomes.site_appearances(pairs, 1).collect()))
    assert got == [("s", 3, 3, 1, "s1", 1), ("t", 1, 1, 1, "s1 - t1", 1)]


def test_mean_field_ranks_against_plain_python(spark):
    rng = np.random.default_rng(2)
    v = 7
    j = np.triu(rng.normal(size=(v, v)) * 0.4, 1)
    j = j + j.T
    names = [f"x{k}" for k in range(v)]
    model = completion.Model(names, rng.normal(size=v), j, np.zeros(v), np.arange(v), np.full(v, -1))
    sites = {f"x{k}": f"s{k // 2}" for k in range(v)}
    problems = {1: ([0, 3], [5]), 2: ([2], [6, 1]), 3: ([4, 5], [0])}
    rows = [(t, f"x{k}", out) for t, both in problems.items() for out, ks in zip((False, True), both, strict=True) for k in ks]
    frame = spark.createDataFrame([*rows, (1, "unknown", True), (2, "unknown", False)], "team_id long, feature string, held_out boolean")
    plain, by_site = set(), set()
    for t, (held, out) in problems.items():
        m = 1 / (1 + np.exp(-model.h))
        m[held] = 1
        for _ in range(400):
            new = 1 / (1 + np.exp(-(model.h + j @ m)))
            new[held] = 1
            m = 0.5 * new + 0.5 * m
        sums = {s: sum(m[k] for k in range(v) if k // 2 == s) for s in range(4)}
        for k in out:
            plain.add((t, f"x{k}", 1 + sum(m[o] > m[k] for o in range(v) if o not in held)))
            by_site.add((t, f"x{k}", 1 + sum(sums[o] > sums[k // 2] for o in sums if o not in {h // 2 for h in held})))
    assert {tuple(r) for r in completion.mean_field_ranks(frame, model).collect()} == plain
    assert {tuple(r) for r in completion.mean_field_ranks(frame, model, sites).collect()} == by_site


def test_ends_and_their_overlap(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0, 3.0), ("a", "c", 2.0, 1.0), ("b", "c", 2.0, 2.0), ("c", "d", -1.0, None)], "i string, j string, u double, w double")
    u, w = outcomes.top_pairs(pairs, "u", 2), outcomes.top_pairs(pairs, "w", 2)
    assert [(r.i, r.j) for r in u.where("positive").orderBy("rank").collect()] == [("a", "c"), ("b", "c")]
    assert [(r.i, r.j) for r in u.where("NOT positive").orderBy("rank").collect()] == [("c", "d"), ("a", "b")]
    got = {r.positive: (r.common, r.either, r.jaccard) for r in outcomes.overlap(u, w, ["positive"]).collect()}
    assert got == {True: (1, 3, pytest.approx(1 / 3)), False: (0, 4, 0.0)}
