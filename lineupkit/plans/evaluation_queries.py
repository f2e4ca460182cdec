"""Registered queries on splits, outcomes and coupling blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import blocks, evaluation, names
from lineupkit.plans import corpus_queries as base
from lineupkit.runtime import table
from lineupkit.sources.domain import MEMBERS_SQL, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


_PLACED = """pl AS (SELECT team_id, month, player, in_person, round(popularity + coherence, 6) AS score,
         CASE WHEN f > 1 THEN 1 - ("placing" - 1) / (f - 1)::DOUBLE END AS placement
  FROM (SELECT *, max("placing") OVER (PARTITION BY month) AS f FROM teams) LEFT JOIN sc USING (team_id))"""


def _placed(s, d):
    placed = evaluation.placement(teams(s, d), "month", "placing")
    scores = base._scores(s, d).select("team_id", F.round("score", 6).alias("score"))
    return placed.join(scores.hint("merge"), "team_id", "left").select("team_id", "month", "player", "in_person", "score", "placement")


@query(
    "b1_normalized_names",
    """SELECT p_partkey, array_to_string(list_transform(string_split_regex(trim(lower(p_name)), '\\s+'), lambda w:
         array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1]) || p[2:]), '-')), ' ') AS name FROM part""",
)
def normalized_names(s, d):
    return table(s, d, "part").select("p_partkey", names.normalize_name(F.col("p_name")).alias("name"))


@query(
    "g1_chronological_split",
    """, n AS (SELECT month, count(*) AS n FROM teams GROUP BY month), c AS (SELECT *, CAST(sum(n) OVER (ORDER BY month) AS BIGINT) AS cumulative FROM n)
       SELECT month, n, cumulative, cumulative - n < round_even((SELECT sum(n) FROM n) * 0.8::DOUBLE, 0) AS train FROM c""",
)
def chronological_split(s, d):
    return evaluation.chronological_split(teams(s, d).groupBy("month").agg(F.count("*").alias("n")), "month", 0.8)


@query("g13_auc", f""", {_PLACED} SELECT round(sum(CASE WHEN p.score > q.score THEN 1 WHEN p.score = q.score THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 8) AS auc
       FROM pl p JOIN pl q ON p.in_person AND NOT q.in_person WHERE p.score IS NOT NULL AND q.score IS NOT NULL""")
def auc(s, d):
    return evaluation.auc(_placed(s, d).where("score IS NOT NULL"), "score", "in_person").select(F.round("auc", 8).alias("auc"))


@query("g14_placement", f""", {_PLACED} SELECT team_id, month, round(placement, 9) AS placement FROM pl""")
def placement(s, d):
    out = evaluation.placement(teams(s, d), "month", "placing")
    return out.select("team_id", "month", F.round("placement", 9).alias("placement"))


@query(
    "g16_event_spearman",
    f""", {_PLACED}, r AS (SELECT month, rank() OVER (PARTITION BY month ORDER BY score) + (count(*) OVER (PARTITION BY month, score) - 1) / 2 AS rx,
         rank() OVER (PARTITION BY month ORDER BY placement) + (count(*) OVER (PARTITION BY month, placement) - 1) / 2 AS ry
         FROM pl WHERE score IS NOT NULL AND placement IS NOT NULL)
       SELECT month, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r GROUP BY month HAVING count(*) >= 8""",
)
def event_spearman(s, d):
    return evaluation.spearman_within(_placed(s, d), "month", "score", "placement").withColumn("rho", F.round("rho", 8))


@query(
    "g19_icc",
    f""", {_PLACED}, g AS (SELECT player, count(*) AS k, sum(placement) AS s, sum(placement * placement) AS ss FROM pl WHERE placement IS NOT NULL GROUP BY player HAVING count(*) >= 2),
       t AS (SELECT count(*) AS g, CAST(sum(k) AS BIGINT) AS n, sum(k * k)::DOUBLE AS kk, sum(s) AS s, sum(ss) AS ss, sum(s * s / k) AS sk FROM g),
       m AS (SELECT *, (sk - s * s / n) / (g - 1) AS b, (ss - sk) / (n - g) AS w, (n - kk / n) / (g - 1) AS k0 FROM t)
       SELECT g AS groups, n, round((b - w) / (b + (k0 - 1) * w), 8) AS icc FROM m""",
)
def icc(s, d):
    return evaluation.icc(_placed(s, d), "player", "placement").withColumn("icc", F.round("icc", 8))


@query(
    "f2_block_anova",
    f""", {base._PAIRMODEL}, ft AS (SELECT DISTINCT feature, species FROM pmem),
       b AS (SELECT x.species AS p, y.species AS q, x.feature AS i, y.feature AS j, coalesce(c.coupling, d.coupling, 0) AS coupling, coalesce(c.coupling, d.coupling) IS NOT NULL AS known
         FROM ft x JOIN ft y ON x.species < y.species LEFT JOIN pcpl c ON c.i = x.feature AND c.j = y.feature LEFT JOIN pcpl d ON d.j = x.feature AND d.i = y.feature),
       e AS (SELECT *, avg(coupling) OVER (PARTITION BY p, q) AS m, avg(coupling) OVER (PARTITION BY p, q, i) AS r, avg(coupling) OVER (PARTITION BY p, q, j) AS c FROM b)
       SELECT p, q, i, j, round(coupling, 7) AS coupling, round(m, 7) AS synergy, round(r - m, 7) AS row, round(c - m, 7) AS col, round(coupling - r - c + m, 7) AS inter FROM e WHERE known""",
)
def block_anova(s, d):
    _, couplings, features = base._pair_model(s, d)
    out = evaluation.blocks(blocks.entries(couplings, features.select("feature", "species")))
    return out.select("p", "q", "i", "j", *[F.round(c, 7).alias(c) for c in ("coupling", "synergy", "row", "col", "inter")])
