"""Registered queries on species blocks and on features of a corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineupkit.operators import blocks, corpus, scoring
from lineupkit.plans import corpus_queries as base
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, species_members
from lineupkit.runtime import stash

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


_CELLS = f"""{base._PAIRMODEL}, cnt AS (SELECT species, count(*)::DOUBLE AS k, sum(m) AS sm FROM pmarg GROUP BY species),
 cell AS (SELECT a.feature AS i, a.species AS p, b.feature AS j, b.species AS q, c.coupling AS b, x.k AS np, y.k AS nq, a.m AS mi, b.m AS mj, x.sm AS smp, y.sm AS smq
   FROM (SELECT i, j, coupling FROM pcpl UNION ALL SELECT j, i, coupling FROM pcpl) c JOIN pmarg a ON a.feature = c.i JOIN pmarg b ON b.feature = c.j
   JOIN cnt x ON x.species = a.species JOIN cnt y ON y.species = b.species WHERE a.species <> b.species),
 grid AS (SELECT a.feature AS i, a.species AS p, b.feature AS j, b.species AS q, coalesce(cell.b, 0) AS b FROM pmarg a JOIN pmarg b ON a.species <> b.species
   LEFT JOIN cell ON cell.i = a.feature AND cell.j = b.feature),
 modu AS (SELECT *, b - avg(b) OVER (PARTITION BY p, q, j) AS d, avg(b) OVER (PARTITION BY p, q) AS mean FROM grid)"""


def _model(s, d):
    fields, couplings, features = base._pair_model(s, d)
    named = stash(features.select("feature", "species").join(fields.select("feature", "m"), "feature"), "block-features")
    return named, stash(blocks.entries(couplings, named), "block-cells")


@query("f1_item_weights", f", {base._PAIRMODEL} SELECT feature, species, round(m / sum(m) OVER (PARTITION BY species), 9) AS weight, round(sum(m) OVER (PARTITION BY species) * (SELECT count(*) FROM teams), 6) AS appearances FROM pmarg")
def item_weights(s, d):
    n = base._weights(s, d).count()
    out = blocks.item_weights(_model(s, d)[0], n)
    return out.select("feature", "species", F.round("weight", 9).alias("weight"), F.round("appearances", 6).alias("appearances"))


@query("f3_row_modulation", f", {_CELLS} SELECT p, q, i, j, round(d, 7) AS modulation FROM modu JOIN (SELECT i, j FROM cell) USING (i, j)")
def row_modulation(s, d):
    return blocks.row_modulation(_model(s, d)[1]).withColumn("modulation", F.round("modulation", 7))


@query("f4_modulation_scores", f""", {_CELLS}, per AS (SELECT p, q, any_value(mean) AS mean, sum(d * d) AS md, sum(b * b) AS fl, count(*) AS c FROM modu GROUP BY p, q)
       SELECT per.p AS species, CAST(any_value(k) AS BIGINT) AS n_items, round(sqrt(sum(md)), 6) AS mod_frob, round(sqrt(sum(md) / sum(c)), 6) AS mod_rms,
       round(CASE WHEN sum(fl) > 1e-12 THEN sum(md) / sum(fl) ELSE 0 END, 6) AS mod_frac, round(sqrt(sum(mean * mean)), 6) AS synergy_frob FROM per JOIN cnt ON cnt.species = per.p GROUP BY per.p""")
def modulation_scores(s, d):
    features, cells = _model(s, d)
    out = blocks.modulation_scores(cells, features)
    return out.select("species", "n_items", *[F.round(c, 6).alias(c) for c in ("mod_frob", "mod_rms", "mod_frac", "synergy_frob")])


@query("f5_item_magnitudes", f", {_CELLS} SELECT i AS feature, any_value(p) AS species, round(sqrt(sum(d * d)), 6) AS magnitude FROM modu GROUP BY i")
def item_magnitudes(s, d):
    features, cells = _model(s, d)
    return blocks.item_magnitudes(cells, features).withColumn("magnitude", F.round("magnitude", 6))


@query("f5_item_partners", f""", {_CELLS}, r AS (SELECT i, j, d, side, row_number() OVER (PARTITION BY i, side ORDER BY round(d * side, 9) DESC, j) AS rank
         FROM (SELECT modu.*, unnest([1, -1]) AS side FROM modu SEMI JOIN cell ON cell.p = modu.p AND cell.j = modu.j))
       SELECT i AS feature, j, round(d, 7) AS delta, CAST(side AS INTEGER) AS side, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def item_partners(s, d):
    features, cells = _model(s, d)
    return blocks.item_partners(cells, features).withColumn("delta", F.round("delta", 7))


@query("f6_apc_graph", f""", {_CELLS}, fr AS (SELECT p, q, sqrt(sum((b - mean) * (b - mean))) AS f FROM modu GROUP BY p, q),
       sy AS (SELECT p, q, sum(b * (mi / smp) * (mj / smq)) AS syn FROM cell GROUP BY p, q), n AS (SELECT count(*)::DOUBLE AS n FROM cnt),
       rm AS (SELECT p, sum(f) / ((SELECT n FROM n) - 1) AS r FROM fr GROUP BY p), g AS (SELECT sum(f) / ((SELECT n FROM n) * ((SELECT n FROM n) - 1)) AS g FROM fr),
       o AS (SELECT fr.p, fr.q, f, CASE WHEN (SELECT g FROM g) > 1e-12 THEN a.r * b.r / (SELECT g FROM g) ELSE 0 END AS apc FROM fr JOIN rm a ON a.p = fr.p JOIN rm b ON b.p = fr.q WHERE fr.p < fr.q)
       SELECT o.p AS species_a, o.q AS species_b, round(f, 6) AS frob, round(apc, 6) AS apc, round(f - apc, 6) AS corrected, round(coalesce(syn, 0), 6) AS synergy FROM o LEFT JOIN sy ON sy.p = o.p AND sy.q = o.q""")
def apc_graph(s, d):
    features, cells = _model(s, d)
    out = blocks.apc_graph(cells, features, blocks.item_weights(features, 1))
    return out.select("species_a", "species_b", *[F.round(c, 6).alias(c) for c in ("frob", "apc", "corrected", "synergy")])


@query("f7_species_synergy", f", {_CELLS} SELECT i AS feature, q AS species, round(sum(b * mj) / any_value(smq), 8) AS synergy FROM cell GROUP BY i, q")
def species_synergy(s, d):
    features, cells = _model(s, d)
    return blocks.species_synergy(cells, features).withColumn("synergy", F.round("synergy", 8))


@query("c8_binary_moments", """SELECT i, j, round(a.m, 9) AS mi, round(b.m, 9) AS mj, round(n * 30 / (SELECT sum(n)::DOUBLE FROM sym), 9) AS p
       FROM cooc JOIN marg a ON a.feature = i JOIN marg b ON b.feature = j""")
def binary_moments(s, d):
    members = species_members(s, d)
    out = corpus.binary_moments(corpus.marginals(members, base._weights(s, d)), corpus.cooccurrence(members), 6)
    return out.select("i", "j", *[F.round(c, 9).alias(c) for c in ("mi", "mj", "p")])


@query("c14_completion_counts", "SELECT roster_key, n, round(n / (SELECT count(*) FROM ros), 9) AS share FROM rcount")
def completion_counts(s, d):
    counts = corpus.roster_counts(species_members(s, d))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("roster_key", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("c15_projected_counts", """, k AS (SELECT team_id, string_agg(DISTINCT species, '-' ORDER BY species) AS species_key, string_agg(feature, '-' ORDER BY feature) AS feature_key FROM pmem GROUP BY team_id),
       c AS (SELECT species_key, feature_key, count(*) AS n FROM k GROUP BY 1, 2)
       SELECT species_key, CAST(sum(n) AS BIGINT) AS n, first(feature_key ORDER BY n DESC, feature_key) AS representative FROM c GROUP BY species_key""")
def projected_counts(s, d):
    """Teams by their species; the most frequent full roster stands for each, ties to the first key."""
    keys = pair_members(s, d).groupBy("team_id").agg(
        F.array_join(F.sort_array(F.collect_set("species")), "-").alias("species_key"), F.array_join(F.sort_array(F.collect_set("feature")), "-").alias("feature_key")
    )
    counts = keys.groupBy("species_key", "feature_key").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.col("feature_key").alias("b")))["b"]
    return counts.groupBy("species_key").agg(F.sum("n").alias("n"), best.alias("representative"))


@query("e32_species_couplings", """, r AS (SELECT i, j, coupling, CAST(row_number() OVER (PARTITION BY i, coupling > 0 ORDER BY round(abs(coupling), 12) DESC, j) AS INTEGER) AS rank FROM csym WHERE coupling <> 0)
       SELECT i, j, round(coupling, 8) AS coupling, rank FROM r WHERE rank <= 10""")
def species_couplings(s, d):
    both = corpus.mirrored(base._model(s, d)[1], "coupling").where("coupling <> 0")
    order = Window.partitionBy("i", F.col("coupling") > 0).orderBy(F.desc(F.round(F.abs("coupling"), 12)), "j")
    return both.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("i", "j", F.round("coupling", 8).alias("coupling"), "rank")


@query("e5_violations", "SELECT team_id, count(*) - count(DISTINCT species) AS species_twice, count(*) - count(DISTINCT item) AS items_twice FROM pmem GROUP BY team_id")
def violations(s, d):
    rows = pair_members(s, d).groupBy("team_id").agg(F.count("*").alias("n"), F.size(F.collect_set("species")).alias("a"), F.size(F.collect_set("item")).alias("b"), F.count("item").alias("held"))
    return rows.select("team_id", (F.col("n") - F.col("a")).alias("species_twice"), (F.col("held") - F.col("b")).alias("items_twice"))


@query("b22_structural_pairs", f", {base._PAIRMODEL} SELECT i, j FROM pcpl WHERE si <> sj AND ti <> tj")
def structural_pairs(s, d):
    _, couplings, features = base._pair_model(s, d)
    a, b = features.toDF("i", "si", "ti"), features.toDF("j", "sj", "tj")
    return couplings.join(a, "i").join(b, "j").where(scoring.structural("si", "sj", "ti", "tj")).select("i", "j")


@query("b23_excluded_features", "SELECT DISTINCT feature FROM pmem WHERE species NOT IN ('Brand#11', 'Brand#12', 'Brand#13') AND feature <> 'Brand#21 @ ECONOMY'")
def excluded_features(s, d):
    """All features but those of the included species and the pinned one."""
    members = pair_members(s, d).select("feature", "species").distinct()
    return members.where(~F.col("species").isin("Brand#11", "Brand#12", "Brand#13") & (F.col("feature") != "Brand#21 @ ECONOMY")).select("feature")


@query("b25_species_search", "SELECT feature, round(m, 9) AS m FROM marg WHERE contains(lower(feature), 'd#2')")
def species_search(s, d):
    m = corpus.marginals(species_members(s, d), base._weights(s, d))
    return m.where(F.lower("feature").contains("d#2")).select("feature", F.round("m", 9).alias("m"))


@query("b26_in_vocabulary", """, v AS (SELECT feature FROM pmem GROUP BY feature HAVING count(*) >= 40)
       SELECT team_id FROM pmem LEFT JOIN v USING (feature) GROUP BY team_id HAVING count(*) = 4 AND count(DISTINCT species) = 4 AND count(v.feature) = 4""")
def in_vocabulary(s, d):
    members = pair_members(s, d)
    vocab = members.groupBy("feature").agg(F.count("*").alias("n_")).where("n_ >= 40")
    rows = members.join(vocab, "feature", "left").groupBy("team_id").agg(F.count("*").alias("n"), F.countDistinct("species").alias("s"), F.count("n_").alias("k"))
    return rows.where("n = 4 AND s = 4 AND k = 4").select("team_id")


@query("a17_team_keys", """, vv AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id FROM (SELECT feature FROM mem GROUP BY feature HAVING count(*) >= 5)),
       k AS (SELECT team_id, string_agg(id, '-' ORDER BY id) AS key, count(*) AS known FROM mem JOIN vv USING (feature) GROUP BY team_id)
       SELECT key, count(*) AS n FROM k JOIN ros USING (team_id) WHERE known = len(roster) GROUP BY key""")
def team_keys(s, d):
    """Rosters wholly in the vocabulary as ascending ids joined by hyphens, with their counts."""
    members = species_members(s, d)
    vocab = members.groupBy("feature").agg(F.count("*").alias("n")).where("n >= 5").select("feature")
    ids = vocab.withColumn("id", F.row_number().over(Window.orderBy("feature")) - 1)
    rows = members.join(ids, "feature", "left").groupBy("team_id").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    return rows.where(F.size("ids") == F.col("n")).groupBy(F.array_join("ids", "-").alias("key")).agg(F.count("*").alias("n"))
