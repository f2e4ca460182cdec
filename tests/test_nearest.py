"""Nearest observed rosters against brute force."""

import random
from collections import Counter

from conftest import SF
from lineupkit.operators import scoring
from lineupkit.plans import registry


def brute(asked, counts):
    return {t: min((len(r - o), -n) for o, n in counts.items()) for t, r in asked.items()}


def found(rows):
    return {r.team_id: (r.delta, -r.n) for r in rows}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    draw = lambda low, high: frozenset(f"f{k:02}" for k in rng.sample(range(low, high), rng.choice([1, 2, 3, 4, 6, 12])))
    counts = {draw(0, 30): rng.randint(1, 9) for _ in range(150)}
    asked = {k: draw(0, 40) for k in range(200)} | {200: frozenset(["none", "of these"])}
    q = spark.createDataFrame([(k, sorted(r)) for k, r in asked.items()], "team_id long, roster array<string>")
    c = spark.createDataFrame([(sorted(r), n) for r, n in counts.items()], "roster array<string>, n long")
    for lattice in (3, 10):
        assert found(scoring.nearest_observed(q, c, lattice).collect()) == brute(asked, counts)
    assert scoring.nearest_observed(q, c.limit(0)).count() == 0


def test_all_teams_meet_all_rosters(spark):
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("lineitem", "part"))
    brand, teams = {p.p_partkey: p.p_brand for p in parts}, {}
    for x in lines:
        if x.l_partkey in brand:
            teams.setdefault(x.l_orderkey, set()).add(brand[x.l_partkey])
    asked = {t: frozenset(r) for t, r in teams.items()}
    got = registry.QUERIES["e25_nearest_observed_all"](spark, SF).collect()
    assert len(got) == len(asked) and found(got) == brute(asked, Counter(asked.values()))
    assert registry.QUERIES["e29_novelty_all"](spark, SF).first().novelty == 0


def test_subsets_are_not_broadcast(spark):
    q = spark.createDataFrame([(k, [f"f{k % 7}", f"g{k % 5}"]) for k in range(50)], "team_id long, roster array<string>")
    c = spark.createDataFrame([([f"f{k}", "g1"], k + 1) for k in range(7)], "roster array<string>, n long")
    plan = scoring.nearest_observed(q, c)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
