"""The fit and the completions against plain numpy."""

import itertools

import numpy as np
import pytest
from lineupkit.operators import completion, corpus, fit
from pyspark.sql import functions as F

NAMES = [f"f{k}" for k in range(6)]


def draws(n=400, seed=1):
    """Teams drawn from a small planted model by enumeration."""
    rng = np.random.default_rng(seed)
    j = np.zeros((6, 6))
    j[0, 1] = j[1, 0] = 1.5
    j[2, 3] = j[3, 2] = -1.5
    states = np.array(list(itertools.product([0, 1], repeat=6)), float)
    p = np.exp(states.sum(1) * -0.4 + 0.5 * np.einsum("si,ij,sj->s", states, j, states))
    return states[rng.choice(64, n, p=p / p.sum())], rng.uniform(0.5, 1.5, n)


def frames(spark, x, w):
    members = [(t, NAMES[k]) for t, row in enumerate(x) for k in np.flatnonzero(row)]
    return spark.createDataFrame(members, "team_id long, feature string").repartition(3), spark.createDataFrame([(t, float(v)) for t, v in enumerate(w)], "team_id long, w double")


def newton(x, w, c, prior=None, weight=1.0):
    v = x.shape[1]
    out = np.zeros((v, v + 1))
    for i in range(v):
        keep = [k for k in range(v) if k != i]
        d = np.column_stack([x[:, keep], np.ones(len(x))])
        centre = np.zeros(v) if prior is None else prior[i, [*keep, v]]
        pull = np.array([1.0] * (v - 1) + [0.0 if prior is None else weight])
        y, t = x[:, i], centre.copy()
        if min(y.sum(), (1 - y).sum(), w[y == 1].sum(), w[y == 0].sum()) < 2:
            out[i, [*keep, v]] = centre
            continue
        for _ in range(60):
            p = 1 / (1 + np.exp(-(d @ t)))
            g = c * d.T @ (w * (p - y)) + pull * (t - centre)
            t = t - np.linalg.solve(c * (d.T * (w * p * (1 - p))) @ d + np.diag(pull), g)
        out[i, [*keep, v]] = t
    return out


def fitted(spark, x, w, c=0.5, prior=None, weight=1.0):
    members, weights = frames(spark, x, w)
    vocab = spark.createDataFrame([(n,) for n in NAMES], "feature string")
    fields, couplings, rows = fit.fit_model(members, weights, vocab, c, prior, weight)
    out = np.zeros((6, 7))
    for r in rows.collect():
        out[NAMES.index(r.i), NAMES.index(r.j)] = r.coupling
    for r in fields.collect():
        out[NAMES.index(r.feature), 6] = r.h
    for r in couplings.collect():
        a, b = NAMES.index(r.i), NAMES.index(r.j)
        assert a < b and r.coupling == pytest.approx((out[a, b] + out[b, a]) / 2)
    return out


def test_fit_equals_newton(spark):
    x, w = draws()
    x[:, 5] = 0
    x[3, 5] = 1  # too little evidence
    got = fitted(spark, x, w)
    assert np.abs(got - newton(x, w, 0.5)).max() < 2e-4 and (got[5] == 0).all()
    assert got[0, 1] > 0.7 and got[2, 3] < -0.7


def test_prior_moves_the_centre(spark):
    x, w = draws(120, 2)
    x[:, 5] = 0
    fields = spark.createDataFrame([(n, 0.3 * k) for k, n in enumerate(NAMES)], "feature string, h double")
    couplings = spark.createDataFrame([("f0", "f1", 2.0), ("f4", "f5", -1.0), ("f0", "unknown", 9.0)], "i string, j string, coupling double")
    prior = np.zeros((6, 7))
    prior[:, 6] = 0.3 * np.arange(6)
    prior[0, 1] = prior[1, 0] = 2
    prior[4, 5] = prior[5, 4] = -1
    got = fitted(spark, x, w, 0.2, (fields, couplings), 0.5)
    assert np.abs(got - newton(x, w, 0.2, prior, 0.5)).max() < 2e-4
    assert got[5, 4] == -1 and got[5, 6] == pytest.approx(1.5)


def random_model(v=9, seed=4):
    rng = np.random.default_rng(seed)
    j = rng.normal(size=(v, v)) * 0.5
    j = np.triu(j, 1) + np.triu(j, 1).T
    return completion.Model([f"x{k}" for k in range(v)], rng.normal(size=v), j, rng.random(v), np.arange(v) // 2, np.array([-1, 0, 1, 0, 2, -1, 1, 3, 2][:v]))


def legal(model, team):
    items = [model.item[k] for k in team if model.item[k] >= 0]
    return len({model.species[k] for k in team}) == len(team) and len(set(items)) == len(items)


def energy(model, team, fw=1.0):
    t = list(team)
    return -fw * model.h[t].sum() - model.j[np.ix_(t, t)].sum() / 2


def test_swaps_and_descent(spark):
    model = random_model()
    teams = {k: t for k, t in enumerate(t for t in itertools.combinations(range(9), 3) if legal(model, t))}
    members = spark.createDataFrame([(k, f"x{i}") for k, t in teams.items() for i in t], "team_id long, feature string")
    pins = members.where("feature = 'x0'")
    got = {}
    for r in completion.ranked_swaps(members, model, 4, 0.5, pins, ["x8"]).collect():
        got.setdefault(r.team_id, []).append(r)
    for k, team in teams.items():
        want = []
        for out, into in itertools.product(team, range(8)):
            new = [into if x == out else x for x in team]
            if out != 0 and into not in team and legal(model, new):
                want.append((round(energy(model, new, 0.5) - energy(model, team, 0.5), 9), out, into))
        own = sorted(got.get(k, []), key=lambda r: r["rank"])
        assert [(r.out, r["in"]) for r in own] == [(f"x{o}", f"x{i}") for _, o, i in sorted(want)[:4]]
        for r, w in zip(own, sorted(want), strict=False):
            assert r.delta_adj == pytest.approx(w[0], abs=1e-8) and r.delta_raw == pytest.approx(-(model.h[w[2]] - model.h[w[1]]) - r.delta_coherence)
    chains = {}
    for r in completion.greedy_descent(members, model, 5).collect():
        chains.setdefault(r.team_id, []).append((r.step, r.out, r["in"], r.delta))
    for k, team in teams.items():
        now = set(team)
        for _, out, into, delta in sorted(chains.get(k, [])):
            new = now - {int(out[1:])} | {int(into[1:])}
            assert energy(model, new) - energy(model, now) == pytest.approx(delta) and delta < 0 and legal(model, new)
            now = new
        if len(chains.get(k, [])) < 5:
            assert all(energy(model, now - {o} | {i}) >= energy(model, now) - 1e-9 for o in now for i in range(9) if i not in now and legal(model, now - {o} | {i}))


def test_mean_field_and_fast_path(spark):
    model = random_model()
    pins = spark.createDataFrame([(1, "x0"), (2, "x2"), (2, "x7"), (3, "x0"), (3, "x1")], "team_id long, feature string")
    held = {1: [0], 2: [2, 7], 3: [0, 1]}
    got = {}
    for r in completion.mean_field(pins, model).collect():
        got.setdefault(r.team_id, {})[r.feature] = r.m
    for k, pinned in held.items():
        m = np.array([got[k][n] for n in model.names])
        assert (m[pinned] == 1).all()
        for i in set(range(9)) - set(pinned):
            ruled_out = not all(legal(model, [p, i]) for p in pinned)
            assert m[i] == 0 if ruled_out else abs(m[i] - 1 / (1 + np.exp(-(model.h[i] + model.j[i] @ m)))) < 1e-3
    out = {}
    for r in completion.fast_path(pins, model, 3).collect():
        out.setdefault(r.team_id, []).append((r.feature, r.problem))
    assert out[3] == [(None, "pins clash")]
    for k in (1, 2):
        team = [int(f[1:]) for f, _ in out[k]]
        assert len(team) == 3 and set(held[k]) <= set(team) and legal(model, team)


def test_swaps_without_legality_equal_the_joins(spark):
    """The swaps of whole teams, with a field weight other than 1, against a plain loop over the vocabulary."""
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "team_id long, feature string")
    fields = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", -1.0), ("d", 2.0)], "feature string, h double")
    couplings = spark.createDataFrame([("a", "b", 1.0), ("a", "d", -3.0), ("b", "d", 0.25)], "i string, j string, coupling double")
    got = completion.ranked_swaps(members, completion.local_model(fields, couplings), 20, 2.0).where("team_id = 1").orderBy("rank").collect()
    assert [(r.out, r["in"], round(r.delta_adj, 6), round(r.delta_raw, 6)) for r in got][:2] == [("a", "d", -1.25, -0.25), ("b", "d", 1.0, 2.5)]
    assert corpus.rosters(members).count() == 2 and F is not None
