"""Enumerated states and the page walk against plain Python."""

import itertools
import math

import numpy as np
import pytest
from lineupkit.operators import ingest, states
from pyspark.sql import functions as F

NAMES = ["a", "b", "c", "d"]


def model(spark, seed=1):
    rng = np.random.default_rng(seed)
    h = dict(zip(NAMES, rng.normal(size=4), strict=True))
    j = {p: float(rng.normal()) for p in itertools.combinations(NAMES, 2)}
    del j["a", "c"]
    fields = spark.createDataFrame([(f, float(x)) for f, x in h.items()], "feature string, h double")
    couplings = spark.createDataFrame([(*p, x) for p, x in j.items()] + [("a", "z", 9.0)], "i string, j string, coupling double")
    weight = {s: math.exp(sum(h[f] for f in s) + sum(x for p, x in j.items() if set(p) <= set(s))) for n in range(5) for s in itertools.combinations(NAMES, n)}
    return fields, couplings, weight


def code(s):
    return sum(1 << NAMES.index(f) for f in s)


def test_states_and_all_pins(spark):
    fields, couplings, weight = model(spark)
    names, energies = states.energies(fields, couplings)
    known = states.probabilities(energies).cache()
    z = sum(weight.values())
    got = {r.state: r.p for r in known.collect()}
    assert names == NAMES and got == pytest.approx({code(s): w / z for s, w in weight.items()})
    marginals = {(r.pins, r.feature): r.marginal for r in states.conditional_marginals(known, names).collect()}
    assert len(marginals) == 4 * 27
    for pins in itertools.product("01.", repeat=4):
        fits = {s: w for s, w in weight.items() if all(p == "." or (f in s) == (p == "1") for f, p in zip(NAMES, pins, strict=True))}
        for f, p in zip(NAMES, pins, strict=True):
            if p == ".":
                assert marginals["".join(pins), f] == pytest.approx(sum(w for s, w in fits.items() if f in s) / sum(fits.values()))
    top = states.top_configurations(known, names, 3, {"b": 1, "d": 0}).collect()
    want = sorted((-math.log(w), code(s), "-".join(s)) for s, w in weight.items() if "b" in s and "d" not in s)[:3]
    assert [(r["rank"], r.state, r.members) for r in top] == [(k + 1, c, m) for k, (_, c, m) in enumerate(want)]
    known.unpersist()


def test_observed_and_bounds(spark):
    members = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z"), (3, "a"), (3, "c")], "team_id long, feature string")
    teams = spark.createDataFrame([(1,), (2,), (3,), (4,)], "team_id long")
    assert {r.state: r.n for r in states.observed_states(members, teams, NAMES).collect()} == {5: 2, 0: 2}
    many = spark.createDataFrame([(f"f{k}", 0.0) for k in range(13)], "feature string, h double")
    none = spark.createDataFrame([], "i string, j string, coupling double")
    with pytest.raises(ValueError):
        states.energies(many, none)
    names, energies = states.energies(many.limit(0), none)
    assert names == [] and energies.count() == 1


def plain_walk(rows, most, start=0):
    """The walk as a loop."""
    pages, seen, out, teams = {}, set(), [], 0
    for page, pos, id_, n, ok, keep in rows:
        pages.setdefault(page, []).append((pos, id_, n, ok, keep))
    page = start
    while page in pages:
        new = 0
        for pos, id_, n, ok, keep in sorted(pages[page]):
            if id_ in seen:
                continue
            seen.add(id_)
            if not ok:
                continue
            new += 1
            if keep:
                out.append((page, pos, id_, teams))
                teams += n
                if teams >= most:
                    return out
        if not new:
            break
        page += 1
    return out


@pytest.mark.parametrize("seed,most,start", [(1, 10**9, 0), (2, 150, 0), (3, 10**9, 4), (4, 1, 0)])
def test_walk_equals_the_loop(spark, seed, most, start):
    rng = np.random.default_rng(seed)
    rows = [(p, k, f"t{rng.integers(0, 60)}", int(rng.integers(0, 30)), bool(rng.random() < 0.7), bool(rng.random() < 0.6)) for p in range(40) if not (seed == 3 and p == 17) for k in range(5)]
    df = spark.createDataFrame(rows, "page long, pos int, id string, teams int, ok boolean, keep boolean").repartition(3)
    got = sorted((r.page, r.pos, r.id, r.before) for r in ingest.walk_pages(df, F.col("ok"), F.col("keep"), most, start, 5).collect())
    assert got == plain_walk(rows, most, start)


def test_walk_over_nothing(spark):
    none = spark.createDataFrame([], "page long, pos int, id string, teams int")
    assert ingest.walk_pages(none, F.lit(True), F.lit(True), 5).count() == 0
    odd = spark.createDataFrame([(0, 0, None, 5), (0, None, "a", 5), (None, 1, "b", 5), (0, 2, "c", None), (1, 0, "d", 2)], none.schema)
    assert [(r.id, r.before) for r in ingest.walk_pages(odd, F.lit(True), F.lit(True), 5).orderBy("page").collect()] == [("c", 0), ("d", 0)]
