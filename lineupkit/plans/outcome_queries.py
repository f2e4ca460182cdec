"""Registered queries on matches, slices of rounds, overlaps of rankings and the further scorers, with their SQL.

Orders of neighbouring keys meet: key k plays in match k div 2 of the one series and (k + 1) div 2 of the other, so a team
plays at most twice; the larger total price wins (ties: the smaller key), and the match's number gives its round of eight.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.operators import completion, corpus, evaluation, outcomes, statistics
from lineupkit.plans import corpus_queries as base
from lineupkit.plans.statistics_queries import _PROBLEMS, _problems, _rounded
from lineupkit.runtime import stash, table
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, rosters, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}
REPLICATES, ROUNDS, TOP = 20, 8, 25
EPS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


_SIDES = """mx AS (SELECT 2 * ((o_orderkey + s) // 2) + s AS match_id, o_orderkey AS team_id, o_totalprice AS p FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS s)),
       mc AS (SELECT *, count(*) OVER (PARTITION BY match_id) AS c, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, team_id) = 1 AS won FROM mx),
       sd AS (SELECT match_id, match_id % 8 + 1 AS round, team_id, won FROM mc WHERE c = 2)"""


def _sides(s: SparkSession, d: str) -> DataFrame:
    """(match_id, round, team_id, won): two rows a match."""
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("team_id"), F.col("o_totalprice").alias("p"), F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    numbered = rows.select("team_id", "p", (2 * F.floor((F.col("team_id") + F.col("s")) / 2) + F.col("s")).cast("long").alias("match_id"))
    met = numbered.groupBy("match_id").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), "team_id"))).alias("both")).where("c = 2")
    sides = met.select("match_id", (F.col("match_id") % ROUNDS + 1).alias("round"), F.posexplode("both").alias("place", "side"))
    return sides.select("match_id", "round", F.col("side.team_id").alias("team_id"), (F.col("place") == 0).alias("won"))


def _match_sql(key: str, slices: str, least: int) -> str:
    return f""", {_SIDES}, ky AS (SELECT team_id, {key} AS key FROM ros), sk AS (SELECT sd.*, coalesce(key, '') AS key FROM sd LEFT JOIN ky USING (team_id)), rn AS (SELECT unnest(range(1, {ROUNDS + 1})) AS round),
       sl AS ({slices}), y AS (SELECT slice, key, rep, CASE WHEN rep > 0 AND substring(md5(rep || '|' || match_id), 1, 1) < '8' THEN NOT won ELSE won END AS y FROM sk JOIN sl USING (round) CROSS JOIN (SELECT unnest(range(0, {REPLICATES + 1})) AS rep)),
       gp AS (SELECT slice, rep, key, count(*) AS k, sum(y::INT)::DOUBLE AS s FROM y GROUP BY ALL),
       ct AS (SELECT slice, rep, CAST(sum(k) // 2 AS BIGINT) AS matches, count(*) FILTER (k >= 2) AS g, CAST(sum(k) FILTER (k >= 2) AS BIGINT) AS n, sum(k * k) FILTER (k >= 2)::DOUBLE AS kk, sum(s) FILTER (k >= 2) AS s, sum(s * s / k) FILTER (k >= 2) AS q FROM gp GROUP BY 1, 2),
       vr AS (SELECT *, (q - s * s / n) / nullif(g - 1, 0) AS b, (s - q) / nullif(n - g, 0) AS w, (n - kk / n) / nullif(g - 1, 0) AS k0 FROM ct WHERE n > 0 AND matches >= {least}),
       ic AS (SELECT *, CASE WHEN b + (k0 - 1) * w > 1e-12 THEN (b - w) / (b + (k0 - 1) * w) END AS icc FROM vr),
       fl AS (SELECT slice, any_value(matches) AS matches, any_value(g) AS groups, any_value(n) AS n, max(icc) FILTER (rep = 0) AS icc, avg(icc) FILTER (rep > 0) AS a, stddev_pop(icc) FILTER (rep > 0) AS sd FROM ic GROUP BY slice)
       SELECT slice, matches, groups, n, round(icc, 7) AS icc, round(a, 7) AS null_mean, round(sd, 7) AS null_sd, round(CASE WHEN sd > 0 THEN (icc - a) / sd END, 4) AS excess FROM fl"""


def _match_icc(s, d, key, slices, least=0):
    keys = rosters(species_members(s, d)).select("team_id", key.alias("key"))
    sides = _sides(s, d).join(keys, "team_id", "left").fillna("", ["key"])
    out = outcomes.match_icc(sides, slices, REPLICATES, least)
    return _rounded(_rounded(out, 7, "icc", "null_mean", "null_sd"), 4, "excess")


@query("g20_winner_flip", _match_sql("array_to_string(roster, '-')", "SELECT 'all' AS slice, round FROM rn", 0))
def winner_flip(s, d):
    """Exact rosters, all rounds."""
    return _match_icc(s, d, F.array_join("roster", "-"), {"all": F.lit(True)})


@query(
    "g21_round_icc",
    _match_sql("roster[1]", "SELECT 'all' AS slice, round FROM rn UNION ALL SELECT 'rounds 1-3', round FROM rn WHERE round <= 3 UNION ALL SELECT 'round ' || round, round FROM rn", 50),
)
def round_icc(s, d):
    """Teams of one first member; every round of 50 matches, the first three and all."""
    number = F.col("round")
    slices = {"all": F.lit(True), "rounds 1-3": number <= 3} | {f"round {r}": number == r for r in range(1, ROUNDS + 1)}
    return _match_icc(s, d, F.get("roster", F.lit(0)), slices, 50)


@query(
    "c18_played_census",
    f""", {_SIDES}, pn AS (SELECT i, j, count(*) AS n FROM pr JOIN sd USING (team_id) GROUP BY i, j)
       SELECT k AS level, (SELECT count(*) FROM pn WHERE n >= k) AS pairs FROM (SELECT unnest([5, 10, 20, 50, 300])::INTEGER AS k)""",
)
def played_census(s, d):
    return corpus.support_census(outcomes.played_pairs(species_members(s, d), _sides(s, d)), [5, 10, 20, 50, 300])


_BRANDS = range(1, 26)


@query(
    "c19_contingency_all",
    "SELECT p.month, " + ", ".join(f"count(*) FILTER (feature = 'Brand#{k}') AS b{k}" for k in _BRANDS) + " FROM teams p JOIN mem USING (team_id) GROUP BY p.month",
)
def contingency_all(s, d):
    """All 25 brands by month."""
    named = species_members(s, d).withColumn("feature", F.concat(F.lit("b"), F.substring_index("feature", "#", -1)))
    return outcomes.contingency(named.join(teams(s, d).select("team_id", "month"), "team_id"), "month", "feature")


@query(
    "c17_site_appearances",
    """, ps AS (SELECT team_id, list(DISTINCT species) AS sites, array_to_string(list_sort(list(DISTINCT feature)), ' - ') AS roster FROM pmem GROUP BY team_id),
       bs AS (SELECT unnest(sites) AS species, roster, n FROM (SELECT roster, any_value(sites) AS sites, count(*) AS n FROM ps GROUP BY roster))
       SELECT species, teams, rosters, CAST(rank AS INTEGER) AS rank, roster, n FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY species) AS BIGINT) AS teams, count(*) OVER (PARTITION BY species) AS rosters,
         row_number() OVER (PARTITION BY species ORDER BY n DESC, roster) AS rank FROM bs) WHERE rank <= 5""",
)
def site_appearances(s, d):
    return outcomes.site_appearances(pair_members(s, d), 5)


_PPMI = """tr AS (SELECT i, sum(n)::DOUBLE AS r FROM {c} GROUP BY i),
       tp AS (SELECT c.i, c.j, greatest(ln(n * (SELECT sum(n) FROM {c})::DOUBLE / (a.r * b.r)), 0) AS v FROM {c} c JOIN tr a ON a.i = c.i JOIN tr b ON b.i = c.j)"""


@query(
    "g6_ppmi_ranks",
    f""", {_PROBLEMS}, {_PPMI.format(c="tj")}, kn AS (SELECT team_id, feature FROM prob WHERE NOT held_out),
       ps AS (SELECT k.team_id, tp.i AS feature, round(sum(v), 9) AS score FROM kn k JOIN tp ON tp.j = k.feature GROUP BY 1, 2),
       p2 AS (SELECT ps.* FROM ps ANTI JOIN kn ON kn.team_id = ps.team_id AND kn.feature = ps.feature)
       SELECT t.team_id, t.feature AS truth, 1 + (SELECT count(*) FROM p2 x WHERE x.team_id = t.team_id AND x.score > coalesce(o.score, 0)) AS rank
       FROM prob t LEFT JOIN p2 o ON o.team_id = t.team_id AND o.feature = t.feature WHERE t.held_out""",
)
def ppmi_ranks(s, d):
    problems, train = _problems(s, d)
    return statistics.cooccurrence_ranks(problems, corpus.shifted_ppmi(corpus.cooccurrence(train)), "ppmi")


def _trained(s, d, train):
    """The closed-form model of the teams before the last fifth of the time."""
    weights = base._weights(s, d).join(train.select("team_id").distinct().hint("merge"), "team_id", "left_semi")
    return completion.local_model(*corpus.log_odds_model(train, weights, base.SUPPORT))


@query("g6_mean_field_ranks")
def mean_field_ranks(s, d):
    problems, train = _problems(s, d)
    return completion.mean_field_ranks(problems, _trained(s, d, train))


@query("g6_pair_field_ranks")
def pair_field_ranks(s, d):
    """Pairs held in by species and item, their marginals summed by species; the vocabulary is the pairs of 10 teams at least."""
    members = pair_members(s, d)
    problems, train = _problems(s, d, members.select("team_id", "feature"))
    common = train.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= 10).select("feature")
    model = _trained(s, d, stash(train.join(common, "feature", "left_semi"), "pair-train"))
    return completion.mean_field_ranks(problems, model, {f: f.split(" @ ")[0] for f in model.names})


_PP = f"""{_PPMI.format(c="sym")}, pp AS (SELECT cpl.i, cpl.j, coupling, v AS ppmi FROM cpl JOIN tp ON tp.i = cpl.i AND tp.j = cpl.j),
       sg AS (SELECT unnest([true, false]) AS positive)"""
_FIRST = "SELECT positive, i, j, coupling, ppmi, row_number() OVER (PARTITION BY positive ORDER BY round(CASE WHEN positive THEN -{v} ELSE {v} END, 9), i, j) AS rank FROM pp CROSS JOIN sg"


def _pairs(s, d):
    return stash(base._model(s, d)[1].join(corpus.shifted_ppmi(corpus.cooccurrence(species_members(s, d))), ["i", "j"]), "pairs")


@query("g26_top_pairs", f", {_PP} SELECT positive, CAST(rank AS INTEGER) AS rank, i, j, round(coupling, 7) AS coupling, round(ppmi, 7) AS ppmi FROM ({_FIRST.format(v='coupling')}) WHERE rank <= {TOP}")
def top_pairs(s, d):
    return _rounded(outcomes.top_pairs(_pairs(s, d), "coupling", TOP).select("positive", "rank", "i", "j", "coupling", "ppmi"), 7, "coupling", "ppmi")


_OVERLAP = "count(*) FILTER (a.i IS NOT NULL AND b.i IS NOT NULL) AS common, count(*) AS either, round(count(*) FILTER (a.i IS NOT NULL AND b.i IS NOT NULL) / count(*)::DOUBLE, 8) AS jaccard"


@query(
    "g26_top_overlap",
    f", {_PP}, a AS (SELECT * FROM ({_FIRST.format(v='coupling')}) WHERE rank <= {TOP}), b AS (SELECT * FROM ({_FIRST.format(v='ppmi')}) WHERE rank <= {TOP}) SELECT positive, {_OVERLAP} FROM a FULL JOIN b USING (positive, i, j) GROUP BY positive",
)
def top_overlap(s, d):
    """The ends of the couplings against those of the PPMI."""
    pairs = _pairs(s, d)
    return _rounded(outcomes.overlap(outcomes.top_pairs(pairs, "coupling", TOP), outcomes.top_pairs(pairs, "ppmi", TOP), ["positive"]), 8, "jaccard")


@query(
    "g26_stability",
    f""", nt AS (SELECT count(*)::DOUBLE AS n FROM teams), sn AS (SELECT feature, count(*) AS n FROM mem GROUP BY feature), ee AS (SELECT unnest({EPS})::DOUBLE AS eps), sg AS (SELECT unnest([true, false]) AS positive),
       je AS (SELECT eps, c.i, c.j, ln((c.n / nt.n + eps) / ((a.n / nt.n + eps) * (b.n / nt.n + eps))) AS v FROM cooc c JOIN sn a ON a.feature = c.i JOIN sn b ON b.feature = c.j, nt, ee),
       tk AS (SELECT * FROM (SELECT eps, positive, i, j, row_number() OVER (PARTITION BY eps, positive ORDER BY round(CASE WHEN positive THEN -v ELSE v END, 9), i, j) AS rank FROM je CROSS JOIN sg) WHERE rank <= {TOP}),
       b AS (SELECT e.eps, positive, i, j FROM tk, ee e WHERE tk.eps = 0.01::DOUBLE)
       SELECT eps, positive, {_OVERLAP.replace('a.i', 'a.rank').replace('b.i', 'b.k')} FROM (SELECT eps, positive, i, j, rank FROM tk) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (eps, positive, i, j) GROUP BY 1, 2""",
)
def stability(s, d):
    """The ends of the couplings at several smoothings against those at 0.01."""
    members = species_members(s, d)
    singles, total = members.groupBy("feature").agg(F.count("*").alias("n")), teams(s, d).agg(F.count("*").cast("double").alias("n"))
    ends = stash(outcomes.top_pairs(outcomes.smoothed_couplings(corpus.cooccurrence(members), singles, total, EPS), "coupling", TOP, ["eps"]), "ends")
    same = ends.where(F.col("eps") == 0.01).withColumn("eps", F.explode(F.array(*map(F.lit, EPS))))
    return _rounded(outcomes.overlap(ends, same, ["eps", "positive"]), 8, "jaccard")


@query(
    "g13_field_weights",
    """, fw AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0])::DOUBLE AS fw), x AS (SELECT fw, in_person AS p, round(fw * popularity + coherence, 6) AS s FROM sc JOIN teams USING (team_id) CROSS JOIN fw),
       r AS (SELECT fw, p, rank() OVER (PARTITION BY fw ORDER BY s) + (count(*) OVER (PARTITION BY fw, s) - 1) / 2 AS rk FROM x), c AS (SELECT fw, sum(rk) FILTER (p) AS t, count(*) FILTER (p)::DOUBLE AS a, count(*) FILTER (NOT p)::DOUBLE AS b FROM r GROUP BY fw)
       SELECT fw AS field_weight, round((t - a * (a + 1) / 2) / (a * b), 6) AS auc FROM c""",
)
def field_weights(s, d):
    """How well in-person teams are told by popularity at several weights beside coherence."""
    rows = stash(base._scores(s, d).join(teams(s, d).select("team_id", "in_person"), "team_id").select("popularity", "coherence", "in_person"), "weights")
    out = []
    for w in (0.0, 0.25, 0.5, 1.0, 2.0):
        scored = rows.select(F.round(w * F.col("popularity") + F.col("coherence"), 6).alias("score"), "in_person")
        out.append(evaluation.auc(scored, "score", "in_person").select(F.lit(w).alias("field_weight"), F.round("auc", 6).alias("auc")))
    return functools.reduce(DataFrame.unionByName, out)
