"""Registered queries on fitted models and completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import completion, corpus, fit, fit_grid
from lineupkit.plans import corpus_queries as base
from lineupkit.plans.statistics_queries import _problems, _train
from lineupkit.runtime import local_table, stash
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


def _fitted(s, d):
    return fit.build_model(species_members(s, d), base._weights(s, d), 2)


@query("d2_fields")
def fields(s, d):
    return _fitted(s, d)["fields"]


@query("d2_couplings")
def couplings(s, d):
    return _fitted(s, d)["couplings"]


@query("d3_prior_centred")
def prior_centred(s, d):
    """A fit that leans on the closed-form model of the same corpus."""
    members, weights = species_members(s, d), base._weights(s, d)
    return fit.build_model(members, weights, 2, 0.1, base._model(s, d))["couplings"]


@query("d18_pair_fields")
def pair_fields(s, d):
    return fit.build_model(fit.pair_features(pair_members(s, d)), base._weights(s, d), 20)["fields"]


@query("g45_symmetry")
def symmetry(s, d):
    return fit.symmetry(_fitted(s, d)["rows"])


@query("d6_mean_field_fields", "SELECT f.feature, round(f.h - coalesce(sum(c.coupling * g.m), 0), 7) AS h FROM fld f LEFT JOIN csym c ON c.i = f.feature LEFT JOIN fld g ON g.feature = c.j GROUP BY f.feature, f.h")
def mean_field_fields(s, d):
    f, c = base._model(s, d)
    return fit.mean_field_fields(f, c).withColumn("h", F.round("h", 7))


def _local(s, d):
    return completion.local_model(*base._model(s, d))


@query("e18_mean_field")
def mean_field(s, d):
    """Every team's first two members as pins."""
    pins = corpus.rosters(species_members(s, d)).select("team_id", F.explode(F.slice("roster", 1, 2)).alias("feature"))
    return completion.mean_field(pins, _local(s, d)).withColumn("m", F.round("m", 6))


@query("e19_greedy_descent")
def greedy_descent(s, d):
    return completion.greedy_descent(species_members(s, d), _local(s, d), 10).withColumn("delta", F.round("delta", 6))


@query("e26_fast_path")
def fast_path(s, d):
    f, c, features = base._pair_model(s, d)
    pins = pair_members(s, d).groupBy("team_id").agg(F.min("feature").alias("feature"))
    return completion.fast_path(pins, completion.local_model(f, c, features), 4)


@query("d4_l1_couplings")
def l1_couplings(s, d):
    """Species couplings under an L1 penalty, many of them exactly 0."""
    members, weights = species_members(s, d), base._weights(s, d)
    vocab = corpus.vocabulary(members, weights, 2)
    names, theta = fit_grid.fit_grid(members, [weights], vocab, [fit_grid.Cell(0.1, "l1")], tol=1e-3)
    return fit_grid.couplings_of(s, names, theta).drop("cell")


def _grid(s, d, weightings: list[tuple[float | None, float]], cells: list[fit_grid.Cell]):
    """Metrics of every cell: fitted on the first four fifths of the time, tested on the last."""
    split = stash(_train(s, d), "split")
    members = species_members(s, d)
    rows = teams(s, d).join(split.where("train").select("team_id"), "team_id", "left_semi")
    problems, train = _problems(s, d)
    weights = [corpus.team_weights(rows, *w) for w in weightings]
    ones = lambda train: [split.where("train" if train else "NOT train").select("team_id", F.lit(1.0).alias("w"))]
    vocab = corpus.vocabulary(train, weights[0], 2)
    names, theta = fit_grid.fit_grid(train, weights, vocab, cells, tol=1e-3)
    near, far = (stash(fit_grid.grid_rosters(members, ones(t), names), "grid-rosters") for t in (True, False))
    return fit_grid.grid_metrics(s, near, far, problems, names, theta)


def _named(s, metrics, columns: dict[str, list], kinds: str):
    n = len(next(iter(columns.values())))
    return local_table(s, [(k, *(c[k] for c in columns.values())) for k in range(n)], f"cell long, {kinds}").join(metrics, "cell").drop("cell")


@query("g10_penalty_grid")
def penalty_grid(s, d):
    """Both penalties at four strengths: likelihood, ranks of held-out members, sparsity."""
    cells = [fit_grid.Cell(c, p) for p in ("l2", "l1") for c in (0.001, 0.01, 0.1, 1.0)]
    metrics = _grid(s, d, [(base.TAU, base.IN_PERSON)], cells)
    return _named(s, metrics, {"penalty": [x.penalty for x in cells], "c": [x.c for x in cells]}, "penalty string, c double")


@query("g39_best_penalty")
def best_penalty(s, d):
    """The strength of the best held-out MRR in each candidate weighting, smaller penalties first among equals."""
    weightings, lambdas = [(None, 1.0), (base.TAU, base.IN_PERSON)], [1.0, 10.0, 100.0]
    cells = [fit_grid.Cell(1 / x, "l2", k) for k in range(len(weightings)) for x in lambdas]
    at = [(w, x) for w in weightings for x in lambdas]
    names = {"tau": [w[0] or 0.0 for w, _ in at], "in_person": [w[1] for w, _ in at], "lambda": [x for _, x in at]}
    rows = _named(s, _grid(s, d, weightings, cells), names, "tau double, in_person double, lambda double")
    best = rows.groupBy("tau", "in_person").agg(F.max_by(F.struct("lambda", "mrr", "test_pll"), F.struct("mrr", -F.col("lambda"))).alias("b"))
    return best.select("tau", "in_person", "b.*")
