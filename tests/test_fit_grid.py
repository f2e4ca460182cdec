"""The stacked grid against single fits, optimality of the L1 rows, likelihood and ranks against plain numpy."""

import numpy as np
import pytest
from lineupkit.operators import fit, fit_grid
from lineupkit.operators.fit_grid import Cell

from test_models import NAMES, draws, frames


@pytest.fixture(scope="module")
def corpus(spark):
    x, w = draws(500, 7)
    x[:, 5] = 0
    x[3, 5] = 1  # too little evidence
    members, weights = frames(spark, x, w)
    ones = weights.selectExpr("team_id", "1.0D AS w")
    rosters = fit_grid.grid_rosters(members, [weights, ones], NAMES)
    return x, w, rosters, members, weights


CELLS = [Cell(0.5), Cell(0.05, "l1"), Cell(0.02, "l1", 1), Cell(0.002, "l1"), Cell(3.0, "l2", 1)]


@pytest.fixture(scope="module")
def theta(corpus):
    return fit_grid.fit_cells(corpus[2], 6, CELLS)


def test_cells_equal_single_fits(spark, corpus, theta):
    x, w, _, members, weights = corpus
    for k, of in ((0, w), (4, np.ones(len(x)))):
        frame = spark.createDataFrame([(t, float(v)) for t, v in enumerate(of)], "team_id long, w double")
        one = fit.fit_rows(fit.coded_rosters(members, frame, NAMES), 6, CELLS[k].c)
        assert np.abs(theta[k] - one).max() < 2e-4
    alone = fit_grid.fit_cells(corpus[2], 6, [CELLS[1]])[0]
    assert np.abs(theta[1] - alone).max() < 1e-4


def test_l1_rows_are_optimal(corpus, theta):
    x, w = corpus[:2]
    for k in (1, 2, 3):
        cell, of = CELLS[k], w if CELLS[k].weighting == 0 else np.ones(len(x))
        for i in range(5):
            b = theta[k, i]
            r = of * (1 / (1 + np.exp(-(x @ b[:6] + b[6]))) - x[:, i])
            g = cell.c * np.r_[x.T @ r, r.sum()]
            rest = [j for j in range(7) if j != i]
            on = [j for j in rest if b[j] != 0]
            assert np.abs(g[on] + np.sign(b[on])).max(initial=0) < 1e-4
            assert np.abs(g[[j for j in rest if b[j] == 0]]).max(initial=0) < 1 + 1e-4
        assert (theta[k, 5] == 0).all()
    zeros = [(theta[k, :5, :5] == 0).sum() for k in (1, 3)]
    assert 5 < zeros[0] < zeros[1]  # exact zeros, more of them where the penalty weighs more


def test_likelihood_ranks_and_metrics(spark, corpus, theta):
    x, _, rosters, members, _ = corpus
    got = fit_grid.mean_pseudo_likelihood(rosters, theta)
    sym = fit_grid.symmetric(theta)
    for k, m in enumerate(sym):
        z = x @ m[:, :6].T + m[:, 6]
        assert got[k] == pytest.approx((x * z - np.logaddexp(0, z)).sum(1).mean())
    teams = [t for t in range(len(x)) if x[t].sum() >= 2]
    problems = spark.createDataFrame([(t, NAMES[k], bool(k == np.flatnonzero(x[t])[0])) for t in teams for k in np.flatnonzero(x[t])] + [(1, "unknown", True)], "team_id long, feature string, held_out boolean")
    ranks = {(r.cell, r.team_id): r["rank"] for r in fit_grid.model_ranks(problems, NAMES, theta).collect()}
    assert len(ranks) == len(teams) * len(CELLS)
    for k, m in enumerate(sym):
        for t in teams:
            held = np.flatnonzero(x[t])[1:]
            z = m[:, 6] + m[:, held].sum(1)
            free = [f for f in range(6) if f not in held]
            truth = np.flatnonzero(x[t])[0]
            assert ranks[k, t] == 1 + sum(z[f] > z[truth] + 1e-12 for f in free)
    rows = {r.cell: r for r in fit_grid.grid_metrics(spark, rosters, rosters, problems, NAMES, theta).collect()}
    for k in range(len(CELLS)):
        assert rows[k].mrr == pytest.approx(np.mean([1 / ranks[k, t] for t in teams])) and rows[k].train_pll == pytest.approx(got[k])
    assert rows[3].sparsity > rows[0].sparsity


def test_no_rows_and_bounds(spark, corpus):
    assert (fit_grid.fit_cells(corpus[2].limit(0), 6, CELLS) == 0).all()
    with pytest.raises(ValueError):
        fit_grid.fit_cells(corpus[2], 6, CELLS, max_values=10)
    with pytest.raises(ValueError):
        Cell(1.0, "l3")
