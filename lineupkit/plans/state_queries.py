"""Registered queries on all states of the eight most frequent species, and on the walk over landed catalog pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import ingest, states
from lineupkit.plans import corpus_queries as base
from lineupkit.runtime import stash, table
from lineupkit.sources.domain import MEMBERS_SQL, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}
_K = 8
_SMALL = f""", tp AS (SELECT feature, h, row_number() OVER (ORDER BY feature) - 1 AS b FROM (SELECT feature, h FROM fld ORDER BY round(m, 12) DESC, feature LIMIT {_K})),
 st0 AS (SELECT CAST(x AS BIGINT) AS state FROM range({1 << _K}) t(x)),
 en AS (SELECT state, -(coalesce((SELECT sum(h) FROM tp WHERE (state >> tp.b) & 1 = 1), 0)
   + coalesce((SELECT sum(coupling) FROM cpl JOIN tp a ON a.feature = cpl.i JOIN tp b ON b.feature = cpl.j WHERE (state >> a.b) & 1 = 1 AND (state >> b.b) & 1 = 1), 0)) AS energy FROM st0),
 pb AS (SELECT state, energy, exp(-energy) / (SELECT sum(exp(-energy)) FROM en) AS p FROM en),
 co AS (SELECT CAST(x AS BIGINT) AS code FROM range({3**_K}) t(x)),
 pn AS (SELECT code, {" || ".join(f"CASE WHEN (code // {3**b}) % 3 = 2 THEN '.' ELSE CAST((code // {3**b}) % 3 AS VARCHAR) END" for b in range(_K))} AS pins,
   {" + ".join(f"CASE WHEN (code // {3**b}) % 3 < 2 THEN {1 << b} ELSE 0 END" for b in range(_K))} AS fixed, {" + ".join(f"CASE WHEN (code // {3**b}) % 3 = 1 THEN {1 << b} ELSE 0 END" for b in range(_K))} AS there FROM co),
 ma AS (SELECT pins, fixed, {", ".join(f"sum(p * ((state >> {b}) & 1)) / sum(p) AS m{b}" for b in range(_K))} FROM pn JOIN pb ON (state & fixed) = there GROUP BY pins, fixed),
 mg AS (SELECT pins, b, CASE b {" ".join(f"WHEN {b} THEN m{b}" for b in range(_K))} END AS marginal FROM ma CROSS JOIN range({_K}) t(b) WHERE (fixed >> b) & 1 = 0)"""


def query(name: str, sql: str, own: bool = False):
    def add(f):
        QUERIES[name], SQL[name] = f, sql if own else f"WITH {MEMBERS_SQL},{base._SHARED}\n{_SMALL} {sql}"
        return f

    return add


def _known(s, d):
    """The closed-form model of the most frequent species: names, and (state, energy, p)."""
    fields, couplings = base._model(s, d)
    top = stash(fields.orderBy(F.desc(F.round("m", 12)), "feature").limit(_K).select("feature", "h"), "top-fields")
    names, energies = states.energies(top, couplings)
    return names, states.probabilities(energies)


@query("e37_exact_enumeration", "SELECT state, round(energy, 7) AS energy, round(p, 9) AS p FROM pb")
def model_states(s, d):
    """Energy and probability of every state."""
    return _known(s, d)[1].select("state", F.round("energy", 7).alias("energy"), F.round("p", 9).alias("p"))


@query("e37_conditional_marginals", "SELECT pins, feature, round(marginal, 7) AS marginal FROM mg JOIN tp USING (b)")
def conditional_marginals(s, d):
    """Every free species under each of the 3^8 sets of pins."""
    names, known = _known(s, d)
    return states.conditional_marginals(known, names).withColumn("marginal", F.round("marginal", 7))


@query("e37_top_configurations", f""", rk AS (SELECT state, energy, p, row_number() OVER (ORDER BY round(energy, 12), state) AS rank FROM pb WHERE (state >> 0) & 1 = 1)
 SELECT CAST(rank AS INTEGER) AS rank, state, (SELECT string_agg(feature, '-' ORDER BY b) FROM tp WHERE (state >> tp.b) & 1 = 1) AS members, round(energy, 7) AS energy, round(p, 9) AS p FROM rk WHERE rank <= 10""")
def top_configurations(s, d):
    """The ten likeliest states with the first species present."""
    names, known = _known(s, d)
    out = states.top_configurations(known, names, 10, {names[0]: 1})
    return out.withColumn("energy", F.round("energy", 7)).withColumn("p", F.round("p", 9))


@query("e38_ranked_marginals", """, ob AS (SELECT t.team_id, coalesce(sum(1 << tp.b), 0) AS state FROM teams t LEFT JOIN (SELECT team_id, b FROM mem JOIN tp USING (feature)) tp ON tp.team_id = t.team_id GROUP BY t.team_id),
 sh AS (SELECT tp.feature, avg((state >> tp.b) & 1) AS observed FROM ob CROSS JOIN tp WHERE state & 1 = 1 GROUP BY tp.feature)
 SELECT feature, round(marginal, 7) AS marginal, round(observed, 7) AS observed, CAST(row_number() OVER (ORDER BY round(marginal, 9) DESC, feature) AS INTEGER) AS rank
 FROM mg JOIN tp USING (b) JOIN sh USING (feature) WHERE pins = '1.......'""")
def ranked_marginals(s, d):
    """The free species beside a pinned first one, ranked by marginal, with the share observed on its teams."""
    names, known = _known(s, d)
    marginals = states.conditional_marginals(known, names).where(F.col("pins") == "1" + "." * (len(names) - 1))
    seen = states.observed_states(species_members(s, d), teams(s, d), names).where("state % 2 = 1")
    share = seen.agg(*[(F.sum(F.col("n") * F.shiftright("state", b).bitwiseAND(F.lit(1))) / F.sum("n")).alias(f"o{b}") for b in range(len(names))])
    observed = share.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in names]), F.array(*[f"o{b}" for b in range(len(names))]))).alias("feature", "observed"))
    packed = marginals.join(observed, "feature").agg(F.sort_array(F.collect_list(F.struct((-F.round("marginal", 9)).alias("k"), "feature", "marginal", "observed"))).alias("all_"))  # at most MOST rows
    rows = packed.select(F.posexplode("all_").alias("p", "r"))
    return rows.select("r.feature", F.round("r.marginal", 7).alias("marginal"), F.round("r.observed", 7).alias("observed"), (F.col("p") + 1).alias("rank"))


@query("e38_observed_states", """, ob AS (SELECT t.team_id, CAST(coalesce(sum(1 << tp.b), 0) AS BIGINT) AS state FROM teams t LEFT JOIN (SELECT team_id, b FROM mem JOIN tp USING (feature)) tp ON tp.team_id = t.team_id GROUP BY t.team_id)
 SELECT state, count(*) AS n, round(any_value(pb.p) * (SELECT count(*) FROM ob), 5) AS expected FROM ob JOIN pb USING (state) GROUP BY state""")
def observed_states(s, d):
    """Teams by state, beside those the model expects."""
    names, known = _known(s, d)
    seen = states.observed_states(species_members(s, d), teams(s, d), names)
    total = seen.agg(F.sum("n").alias("t_"))
    return seen.join(known, "state").crossJoin(F.broadcast(total)).select("state", "n", F.round(F.col("p") * F.col("t_"), 5).alias("expected"))


_PAGES = """SELECT o_orderkey // 50 AS page, CAST(o_orderkey % 50 AS INTEGER) AS pos, CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'P' THEN 'M-B' ELSE 'M-A' END AS regulation,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'Weekly Singles Cup' ELSE 'Weekly Cup' END AS name, CAST(o_orderkey % 200 AS INTEGER) AS players, CAST(o_orderkey % 200 - o_custkey % 7 AS INTEGER) AS teams FROM orders"""


@query("a4_walk", f"""WITH pg AS ({_PAGES}), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, pos) = 1 AS fresh FROM pg),
 pc AS (SELECT page, count(*) FILTER (fresh AND regulation = 'M-A') AS fresh_n FROM f GROUP BY page),
 ls AS (SELECT coalesce(max(page) FILTER (k = page + 1), -1) AS last FROM (SELECT page, row_number() OVER (ORDER BY page) AS k FROM pc WHERE fresh_n > 0)),
 kp AS (SELECT * FROM f WHERE fresh AND regulation = 'M-A' AND NOT contains(lower(name), 'singles') AND players >= 64 AND teams >= 64 AND page <= (SELECT last FROM ls)),
 rn AS (SELECT *, coalesce(sum(teams) OVER (ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kp)
 SELECT page, pos, id, teams, CAST(before AS BIGINT) AS before FROM rn WHERE before < 30000""", own=True)
def walk(s, d):
    """Catalog pages made of the orders, 50 a page, walked until 30,000 teams or a page without a new event."""
    o = table(s, d, "orders")
    rows = o.select(
        F.floor(F.col("o_orderkey") / 50).cast("long").alias("page"), (F.col("o_orderkey") % 50).cast("int").alias("pos"), F.col("o_custkey").cast("string").alias("id"),
        F.when(F.col("o_orderstatus") == "P", "M-B").otherwise("M-A").alias("regulation"), F.when(F.col("o_orderpriority") == "5-LOW", "Weekly Singles Cup").otherwise("Weekly Cup").alias("name"),
        (F.col("o_orderkey") % 200).cast("int").alias("players"), (F.col("o_orderkey") % 200 - F.col("o_custkey") % 7).cast("int").alias("teams"),
    )
    keep = ~F.lower("name").contains("singles") & (F.col("players") >= 64) & (F.col("teams") >= 64)
    return ingest.walk_pages(rows, F.col("regulation") == "M-A", keep, 30_000).select("page", "pos", "id", "teams", "before")


@query("b24_inactive_tracks", """WITH v AS (SELECT DISTINCT p_brand, p_type FROM part), t AS (SELECT 0 AS place, 'species' AS name, true AS "unique" UNION ALL SELECT 1, 'item', true)
 SELECT place, name, "unique" AND place <> 1 AS "unique", CASE place WHEN 0 THEN (SELECT count(DISTINCT p_brand) FROM v) ELSE (SELECT count(DISTINCT p_type) FROM v) END AS n_values FROM t""", own=True)
def inactive_tracks(s, d):
    """The tracks of the parts' vocabulary with the item track made inactive, and how many values each has."""
    part = table(s, d, "part")
    counts = part.agg(F.count_distinct("p_brand").alias("species"), F.count_distinct("p_type").alias("item"))
    tracks = counts.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n_values")) for n in ("species", "item")])).alias("place", "t"))
    return ingest.deactivate_tracks(tracks.select("place", "t.name", F.lit(True).alias("unique"), "t.n_values"), [1])
