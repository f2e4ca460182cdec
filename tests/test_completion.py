"""Greedy fill, co-occurrence scores and variety against plain Python; swaps and descents in batches of one and of many."""

import itertools

import numpy as np
import pytest

from lineupkit.operators import completion, corpus, scoring


def _random_teams(count=60, v=9, seed=3):
    rng = np.random.default_rng(seed)
    return {k: sorted(rng.choice(v, rng.integers(1, 6), replace=False).tolist()) for k in range(count)}


def _rows(spark, teams):
    return spark.createDataFrame([(k, f"x{i}") for k, t in teams.items() for i in t], "team_id long, feature string")


def test_greedy_fill_and_scores(spark):
    teams = _random_teams()
    teams[100] = [20]  # meets nothing, so it takes the first names
    teams[101] = [0, 1, 2, 3, 4, 5]  # full already
    members = _rows(spark, teams)
    counts = corpus.cooccurrence(members.where("team_id <> 101"))
    met = {}
    for k, t in teams.items():
        for i, j in itertools.permutations(t, 2) if k != 101 else ():
            met[f"x{i}", f"x{j}"] = met.get((f"x{i}", f"x{j}"), 0) + 1
    vocab = sorted({f"x{i}" for t in teams.values() for i in t})
    score = lambda held, f: sum(met.get((f, g), 0) for g in held)
    held = {k: [f"x{i}" for i in (t if k > 99 else t[:2])] for k, t in teams.items()}
    asked = spark.createDataFrame([(k, f) for k, t in held.items() for f in t], "team_id long, feature string")
    want = {(k, f, score(t, f)) for k, t in held.items() for f in vocab}
    assert sorted(map(tuple, scoring.cooccurrence_scores(asked, counts, members.select("feature")).collect())) == sorted(want)
    assert {tuple(r) for r in scoring.cooccurrence_scores(asked, counts).collect()} == {r for r in want if r[2] > 0}
    for size in (5, 40):  # more than the vocabulary holds: teams stop with all of it
        filled = []
        for k, t in held.items():
            now = list(t)
            filled += [(k, f, 0) for f in t]
            step = 0
            while len(now) < min(size, len(vocab)):
                step += 1
                now.append(min((f for f in vocab if f not in now), key=lambda f: (-score(now, f), f)))
                filled.append((k, now[-1], step))
        if size == 40:
            filled = [r for r in filled if r[0] in (0, 100)]
            asked = asked.where("team_id IN (0, 100)")
            size = len(vocab) + 2
        got = scoring.cooccurrence_greedy(asked, counts, members.select("feature"), size)
        assert sorted(map(tuple, got.collect())) == sorted(filled)
    empty = scoring.cooccurrence_greedy(asked.where("false"), counts, members.select("feature"), 4)
    assert empty.count() == 0 and scoring.cooccurrence_scores(asked, counts.where("false")).count() == 0


def test_variety_of_unlike_sizes(spark):
    rows = [(g, t, f) for g, teams in {"a": {1: "xyz", 2: "xy", 3: "wv", 4: "xyz"}, "b": {1: "xy"}}.items() for t, fs in teams.items() for f in fs]
    got = dict(map(tuple, scoring.variety(spark.createDataFrame(rows, '`group` string, team_id long, feature string')).collect()))
    sets = [set("xyz"), set("xy"), set("wv"), set("xyz")]
    assert got["a"] == pytest.approx(np.mean([max(len(p), len(q)) - len(p & q) for p, q in itertools.combinations(sets, 2)]))
    assert got["b"] is None


def test_batches_of_one_equal_batches_of_many(spark, monkeypatch):
    rng = np.random.default_rng(8)
    j = np.triu(rng.normal(size=(9, 9)).round(1), 1)
    model = completion.Model([f"x{k}" for k in range(9)], rng.normal(size=9).round(1), j + j.T, rng.random(9), np.arange(9) // 2, np.array([-1, 0, 1, 0, 2, -1, 1, 3, 2]))
    members = _rows(spark, _random_teams()).union(spark.createDataFrame([(200, "unknown"), (0, "unknown")], "team_id long, feature string")).coalesce(1)
    found = []
    for cells in (1, 1 << 20):
        monkeypatch.setattr(completion, "_CELLS", cells)
        model_rows = [
            completion.ranked_swaps(members, model, 7, 0.5),
            completion.greedy_descent(members, model, 4),
            completion.mean_field(members, model, top=3),
            completion.fast_path(members.where("team_id % 3 = 0"), model, 4),
        ]
        found.append([sorted(map(str, (tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in f.collect()))) for f in model_rows])
    assert found[0] == found[1] and all(found[0])


def test_model_without_features(spark):
    fields = spark.createDataFrame([], "feature string, h double")
    model = completion.local_model(fields, spark.createDataFrame([], "i string, j string, coupling double"))
    members = spark.createDataFrame([(1, "a")], "team_id long, feature string")
    assert completion.ranked_swaps(members, model).count() == 0 and completion.greedy_descent(members, model).count() == 0
    assert completion.mean_field(members, model).count() == 0
    assert [tuple(r) for r in completion.fast_path(members, model, 2).collect()] == [(1, None, "too few features")]


def test_equal_sets_are_filled_once(spark, monkeypatch):
    sizes, written = {}, scoring.stash
    def counted(df, label):  # noqa: E306
        out = written(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out
    monkeypatch.setattr(scoring, "stash", counted)  # noqa: E305
    counts = spark.createDataFrame([("a", "b", 3), ("a", "c", 2), ("b", "c", 1)], "i string, j string, n long")
    vocab = spark.createDataFrame([(f,) for f in "abcd"], "feature string")
    held = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(100)], "team_id long, feature string")
    got = scoring.cooccurrence_greedy(held, counts, vocab, 3).collect()
    want = {0: {("a", 0), ("b", 1), ("c", 2)}, 1: {("b", 0), ("a", 1), ("c", 2)}}
    assert len(got) == 300 and all({(r.feature, r.step) for r in got if r.team_id == k} == want[k % 2] for k in range(100))
    assert sizes["greedy"] == 2 and sizes["greedy-scores"] < 20  # 100 teams hold two sets


def test_equal_teams_are_worked_on_once(spark):
    model = completion.Model(["a", "b", "c"], np.zeros(3), np.zeros((3, 3)), np.full(3, 0.5), np.arange(3), np.full(3, -1))
    seen = spark.sparkContext.accumulator(0)

    def work(own, teams, pins):
        seen.add(len(teams))
        return np.arange(len(teams)), teams[:, 0]

    members = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(90)], "team_id long, feature string")
    pins = spark.createDataFrame([(k, "c") for k in range(0, 90, 3)], "team_id long, feature string")
    got = completion._each(members, model, work, "team_id long, feature string", pins).collect()
    assert sorted(map(tuple, got)) == [(k, "abc"[k % 3]) for k in range(90)]
    assert seen.value == 3
