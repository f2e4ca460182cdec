"""What must not depend on a table's file size: no broadcast of tables that grow with the teams, no shuffle of what is met already."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineupkit.operators import completion, corpus, statistics
from lineupkit.plans import registry
from lineupkit.runtime import dealt, stash, table_bytes

from conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weights_and_pairs_are_never_broadcast(spark):
    ids = spark.range(400).select(F.col("id").alias("team_id"))
    members = stash(ids.select("team_id", F.explode(F.array(*map(F.lit, "abc"))).alias("feature")), "size-members")
    weights = stash(ids.withColumn("w", F.lit(1.0)), "size-weights")
    fields, couplings = corpus.log_odds_model(members, weights, 10)
    for df in (fields, couplings, corpus.marginals(members, weights), corpus.empirical_moments(members, weights), corpus.vocabulary(members, weights, 1)):
        assert not re.search(r"BroadcastHashJoin \[team_id", _plan(df))
    assert corpus.empirical_moments(members, weights).count() == 6


def _shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", _plan(df))


def test_tasks_grow_with_the_files(spark):
    rows = spark.range(100)
    assert dealt(rows, "id", 9, 1).rdd.getNumPartitions() == 9  # nine files' worth of tasks, of which 4 is the session's number
    assert dealt(rows, "id", 0, 1).count() == dealt(rows, "id", 9, 1).count() == 100
    assert table_bytes(spark, SF, "lineitem") == Path(f"{SF}/lineitem.parquet").stat().st_size


def test_violations_deal_lines_by_team_once(spark):
    """e5: one shuffle by part on either side, one by team; none of rows copied for each distinct count."""
    df = registry.QUERIES["e5_violations"](spark, SF)
    assert "Expand" not in _plan(df) and len(_shuffles(df)) == 3


def test_pairs_meet_a_short_model_where_they_are(spark):
    """e4: no pair of a team is dealt by its features."""
    df = registry.QUERIES["e4_pairwise_rows"](spark, SF)
    assert len(_shuffles(df)) == 3 and "SortMergeJoin [i" not in _plan(df)


def test_pseudo_likelihood_sums_each_team_where_it_is(spark):
    """g9: rows of a team and a touched feature are not shuffled."""
    assert len(_shuffles(registry.QUERIES["g9_pseudo_likelihood"](spark, SF))) == 3


def test_dealt_correlations_against_plain_python_without_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(f"e{k % 3}", k * 7 - 50, float(rng.normal()), float(rng.normal())) for k in range(90)]
    loose = [(None, 901, 1.0, 2.0), ("e1", 902, None, 2.0), ("e1", 903, 1.0, None)]
    frame = spark.createDataFrame(rows + loose, "event string, key long, x double, y double")
    got = statistics.dealt_correlations(frame, "event", "key", "x", "y", 4)
    plain = {}
    for r in range(1, 5):
        xs, ys = [], []
        for e in ("e0", "e1", "e2"):
            own = sorted(row[1:] for row in rows if row[0] == e)
            xs += [x for _, x, _ in own]
            ys += [y for _, _, y in sorted(own, key=lambda row: hashlib.md5(f"{r}|{row[0]}".encode()).hexdigest())]
        plain[r] = np.corrcoef(xs, ys)[0, 1]
    assert "Generate" not in _plan(got) and len([x for x in _shuffles(got) if "event" in x]) == 1
    assert dict(map(tuple, got.collect())) == pytest.approx(plain)
    same = statistics.dealt_correlations(frame.withColumn("y", F.lit(1.0)), "event", "key", "x", "y", 1)
    assert [r.r for r in same.collect()] == [None]


def test_sites_of_many_teams_against_plain_python(spark):
    """e7: one pass over the teams in place of a search for teams alike; the same choice as site by site."""
    rng = np.random.default_rng(11)
    names = [f"f{k:02d}" for k in range(24)]
    model = completion.Model(names, np.zeros(24), np.zeros((24, 24)), rng.integers(1, 5, 24) / 10, rng.integers(0, 6, 24), rng.integers(-1, 4, 24))
    barred = {"f03", "f10"}
    sites = {t: sorted(rng.choice(names, rng.integers(1, 4), replace=False)) for t in range(120)}
    pins = {t: sorted(rng.choice(names, rng.integers(0, 3), replace=False)) for t in range(120)}
    plain = set()
    for t, wanted in sites.items():
        placed, found = [names.index(p) for p in pins[t]], []
        for w in map(names.index, wanted):
            held = {int(model.item[p]) for p in placed if model.item[p] >= 0}
            free = [k for k in range(24) if model.species[k] == model.species[w] and names[k] not in barred and int(model.item[k]) not in held and all(model.species[k] != model.species[p] for p in placed)]
            if not free:
                found = [None]
                break
            placed.append(min(free, key=lambda k: (-model.m[k], k)))
            found.append(names[placed[-1]])
        plain |= {(t, f, None if f else "no feature can stand on a site") for f in found}
    frame = lambda sets: spark.createDataFrame([(t, str(f)) for t, some in sets.items() for f in [*some, "unknown"]], "team_id long, feature string")
    got = completion.resolve_sites(frame(sites), model, frame(pins), sorted(barred))
    assert _plan(got).count("SortMergeJoin") == 1  # pins beside sites, no sets beside teams
    assert {tuple(r) for r in got.collect()} == plain and len(plain) > 120
