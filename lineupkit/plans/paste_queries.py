"""Registered queries on pastes, tokens, stored models and pinned sites, with their SQL.

A team's paste has a block for each of its lines, written in one of several ways by the part's size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lineupkit.operators import artifacts, completion, corpus, fit, names, pastes
from lineupkit.plans import corpus_queries as base
from lineupkit.runtime import table, work_path
from lineupkit.sources.domain import MEMBERS_SQL, pair_members, rosters, species_members, teams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {MEMBERS_SQL},{base._SHARED}\n{sql}"
        return f

    return add


_BLOCK = """CASE p_size % 7 WHEN 0 THEN 'Nick Name (' || p_brand || ') @ ' || p_type WHEN 1 THEN '  ' || p_brand || ' (M) @ ' || lower(p_type) || '  ' WHEN 2 THEN p_brand || '-Mega-X' WHEN 3 THEN 'Old (Boy) (' || p_brand || ') (f)'
  WHEN 4 THEN 'Nobody @ ' || p_type WHEN 5 THEN p_brand || ' @ Nothing' ELSE p_brand || '-mega @ ' || p_type END"""
_TEXT = f"""pst AS (SELECT l_orderkey AS paste_id, string_agg({_BLOCK} || chr(10) || 'Ability: None @ All', chr(10) || ' ' || chr(10) ORDER BY l_linenumber, {_BLOCK}) || chr(10) || chr(10) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  blk AS (SELECT paste_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS b, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS p FROM pst),
  hd AS (SELECT paste_id, p, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM blk),
  sp AS (SELECT paste_id, row_number() OVER (PARTITION BY paste_id ORDER BY p) - 1 AS pos, CASE WHEN contains(line, ' @ ') THEN nullif(trim(regexp_extract(line, '^.* @ (.*)$', 1)), '') END AS item,
    trim(regexp_replace(CASE WHEN contains(line, ' @ ') THEN trim(regexp_extract(line, '^(.*) @ .*$', 1)) ELSE line END, '(?i)\\s*\\((?:M|F)\\)\\s*$', '')) AS nm FROM hd WHERE line IS NOT NULL),
  mn AS (SELECT paste_id, pos, item, CASE WHEN regexp_matches(nm, '^.*\\s+\\(([^)]+)\\)\\s*$') THEN regexp_extract(nm, '^.*\\s+\\(([^)]+)\\)\\s*$', 1) ELSE nm END AS species FROM sp),
  mons AS (SELECT *, regexp_replace(regexp_replace(lower(species), '-mega(-[xyz])?$', ''), '[^a-z0-9-]', '', 'g') AS species_slug, regexp_replace(lower(item), '[^a-z0-9]+', '-', 'g') AS item_slug FROM mn)"""
_RESOLVED = f"""{_TEXT}, voc AS (SELECT feature, species, item, round(sum(w) / (SELECT sum(w) FROM wts), 12) AS m, lower(replace(species, '#', '')) AS ss, replace(lower(item), ' ', '-') AS its FROM pmem JOIN wts USING (team_id) GROUP BY ALL),
  bst AS (SELECT ss, arg_min(feature, r) AS feature, arg_min(item, r) AS item FROM (SELECT *, row_number() OVER (PARTITION BY ss ORDER BY m DESC, feature) AS r FROM voc) GROUP BY ss),
  res AS (SELECT mons.*, CASE WHEN item_slug IS NULL THEN bst.feature ELSE voc.feature END AS feature, CASE WHEN item_slug IS NULL THEN bst.item ELSE voc.item END AS feature_item,
    CASE WHEN bst.ss IS NULL THEN mons.species ELSE mons.species || ' @ ' || mons.item END AS label
    FROM mons LEFT JOIN bst ON bst.ss = species_slug LEFT JOIN voc ON voc.ss = species_slug AND voc.its = item_slug)"""


def _pastes(s, d):
    parts = table(s, d, "part").select("p_partkey", F.concat(F.expr(_BLOCK), F.lit("\nAbility: None @ All")).alias("block"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("paste_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey")
    blocks = lines.groupBy("paste_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "block")))["block"].alias("b"))
    return blocks.select("paste_id", F.concat(F.array_join("b", "\n \n"), F.lit("\n\n")).alias("text"))


def _vocab(s, d):
    members = pair_members(s, d)
    m = corpus.marginals(members.select("team_id", "feature"), base._weights(s, d))
    return m.join(members.select("feature", "species", "item").distinct(), "feature")


def _mons(s, d):
    return pastes.parsed_mons(_pastes(s, d)).where("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("long"))


@query("b18_parsed_pastes", f", {_TEXT} SELECT paste_id, pos, species, item, species_slug, item_slug FROM mons")
def parsed_pastes(s, d):
    return _mons(s, d)


@query("b19_resolved", f", {_RESOLVED} SELECT paste_id, pos, feature, CASE WHEN feature IS NULL THEN label || ' is not in this model, so it was skipped.' END AS warning FROM res")
def resolved(s, d):
    return pastes.resolve(_mons(s, d), _vocab(s, d)).select("paste_id", "pos", "feature", "warning")


@query(
    "b20_matched_pastes",
    f""", {_RESOLVED}, st AS (SELECT DISTINCT paste_id, 0 AS p, []::VARCHAR[] AS fs, []::VARCHAR[] AS ss, []::VARCHAR[] AS its, []::VARCHAR[] AS hs, []::VARCHAR[] AS ws FROM pst
       UNION ALL SELECT st.paste_id, p + 1, CASE WHEN ok THEN fs || [r.feature] ELSE fs END, CASE WHEN ok THEN ss || [r.species_slug] ELSE ss END, CASE WHEN ok THEN its || [r.feature_item] ELSE its END,
         CASE WHEN ok THEN hs || [r.species] ELSE hs END, CASE WHEN len(fs) >= 4 THEN ws WHEN r.feature IS NULL THEN ws || [r.label || ' is not in this model, so it was skipped.']
           WHEN twice THEN ws || [r.species || ' also holds ' || r.feature_item || ' (' || hs[list_position(its, r.feature_item)] || ' has it), so it was skipped.'] ELSE ws END
       FROM (SELECT st.*, res AS r, len(fs) < 4 AND res.feature IS NOT NULL AND NOT list_contains(ss, res.species_slug) AND NOT list_contains(its, res.feature_item) AS ok,
         len(fs) < 4 AND res.feature IS NOT NULL AND NOT list_contains(ss, res.species_slug) AND list_contains(its, res.feature_item) AS twice FROM st JOIN res ON res.paste_id = st.paste_id AND res.pos = st.p) st)
       SELECT paste_id, array_to_string(arg_max(fs, p), ',') AS features, array_to_string(arg_max(ws, p), ',') AS warnings, CASE WHEN len(arg_max(fs, p)) = 0 THEN 'Nothing of the paste matched this model.' END AS error FROM st GROUP BY paste_id""",
)
def matched_pastes(s, d):
    out = pastes.match(_pastes(s, d), _vocab(s, d), 4)
    return out.select("paste_id", F.array_join("features", ",").alias("features"), F.array_join("warnings", ",").alias("warnings"), "error")


def _members(s, d):
    """Rosters as (species, item) in order; every third type counts as no item, every seventh as None."""
    size = F.length("item")
    item = F.when(size % 7 == 0, "None").when(size % 3 > 0, F.col("item"))
    rows = pair_members(s, d).groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("species", "item"))).alias("m"))
    flat = rows.select("team_id", F.posexplode("m").alias("pos", "x")).select("team_id", "pos", "x.*").withColumn("item", item)
    return flat.groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("pos", "species", "item"))).alias("m")).select("team_id", F.transform("m", lambda x: F.struct(x["species"].alias("species"), x["item"].alias("item"))).alias("members"))


_HELD_ITEM = "CASE WHEN length(item) % 7 = 0 THEN 'None' WHEN length(item) % 3 > 0 THEN item END"
_SLUG = "lower(replace(species, '#', ''))"


@query("a21_exported_pastes", f", x AS (SELECT team_id, species, item, {_SLUG} AS slug, {_HELD_ITEM} AS held FROM pmem) SELECT team_id, string_agg(slug || CASE WHEN held <> 'None' THEN ' @ ' || held ELSE '' END, chr(10) || chr(10) ORDER BY species, item) AS text FROM x GROUP BY team_id")
def exported_pastes(s, d):
    return _members(s, d).select("team_id", pastes.export(F.col("members")).alias("text"))


@query("b21_share_tokens", f""", x AS (SELECT team_id, species, item, {_SLUG} AS slug, {_HELD_ITEM} AS held FROM pmem)
       SELECT team_id, 'reg-x.' || string_agg(slug || CASE WHEN held IS NOT NULL THEN '~' || replace(lower(held), ' ', '-') ELSE '' END, '_' ORDER BY species, item) || '_brand99' AS token, count(*) + 1 AS mons, 'reg-x' AS model_id FROM x GROUP BY team_id""")
def share_tokens(s, d):
    """Tokens, and what is read back from them behind a former segment of digits."""
    rows = _members(s, d).select("team_id", pastes.share_token(F.lit("reg-x"), F.col("members"), F.array(F.lit("Brand#99"))).alias("token"))
    back = pastes.read_token(F.regexp_replace("token", r"^reg-x\.", "reg-x.12."))
    return rows.select("team_id", "token", F.size(back["mons"]).cast("long").alias("mons"), back["model_id"].alias("model_id"))


@query("b17_species_slugs", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN replace(lower(replace(p_brand, '#', '')), ' ', '') || '-hisui' WHEN 1 THEN 'rotom-wash' WHEN 2 THEN 'porygonz' ELSE lower(replace(p_brand, '#', '')) || '-ab' END AS slug FROM part""")
def species_slugs(s, d):
    raw = F.expr("CASE p_size % 4 WHEN 0 THEN 'Hisuian ' || p_brand WHEN 1 THEN 'Wash Rotom' WHEN 2 THEN 'Porygon-Z' ELSE p_brand || '-A-B' END")
    return table(s, d, "part").select("p_partkey", names.species_slug(raw).alias("slug"))


_VOC = "ids AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS k FROM (SELECT DISTINCT feature FROM mem))"


def _ids(s, d):
    return corpus.vocabulary(species_members(s, d), base._weights(s, d), 0)


@query("a16_packed_triangle", f", {_VOC} SELECT CAST(greatest(a.k, b.k) * (greatest(a.k, b.k) - 1) // 2 + least(a.k, b.k) AS BIGINT) AS position, round(coupling::DOUBLE, 4) AS value FROM cpl JOIN ids a ON a.feature = cpl.i JOIN ids b ON b.feature = cpl.j")
def packed_triangle(s, d):
    packed = artifacts.pack_triangle(base._model(s, d)[1], _ids(s, d))
    return packed.select("position", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("a15_stored_model", ", o AS (SELECT i, j, coupling FROM csym) SELECT i, j, round(coupling, 8) AS coupling FROM o")
def stored_model(s, d):
    """A model written, read back with its couplings in both directions."""
    fields, couplings = base._model(s, d)
    path = work_path(s, "model")
    tables = {"fields": fields, "couplings": couplings, "team_counts": corpus.roster_counts(species_members(s, d))}
    artifacts.write_model(tables, path, {"id": "m", "type": "standard", "regulation": "X", "n_corpus_teams": 0, "team_size": 6})
    return artifacts.read_model(s, path)["couplings"].withColumn("coupling", F.round("coupling", 8))


@query("a18_manifest", "SELECT 'm-' || lower(o_orderpriority) AS id, count(*) AS n_corpus_teams, o_orderpriority = '3-MEDIUM' AS is_default FROM orders GROUP BY o_orderpriority")
def manifest(s, d):
    """A model for each order priority."""
    models = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n_corpus_teams"))
    rows = models.select(F.concat(F.lit("m-"), F.lower("o_orderpriority")).alias("id"), "n_corpus_teams")
    return artifacts.manifest(rows, "m-none", "m-3-medium")


@query("a20_prefix_fits")
def prefix_fits(s, d):
    """Fits on the first 500 teams and on all."""
    return fit.prefix_fits(species_members(s, d), teams(s, d), [500, None], 10).withColumn("coupling", F.round("coupling", 6))


@query("e7_resolved_sites")
def resolved_sites(s, d):
    """First and second species of every team as sites, its last feature pinned."""
    f, c, features = base._pair_model(s, d)
    members = pair_members(s, d)
    sites = rosters(members.select("team_id", "feature")).select("team_id", F.explode(F.slice("roster", 1, 2)).alias("feature"))
    pins = members.groupBy("team_id").agg(F.max("feature").alias("feature"))
    return completion.resolve_sites(sites, completion.local_model(f, c, features), pins)
