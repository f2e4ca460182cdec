"""Registered queries on names and ingest, with their SQL.

Raw standings are made from the tables: a month is an event, an order an entry, its parts the decklist with names in several
spellings, customers the players (some enter an event twice), neighbours by number the opponents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineupkit.operators import ingest, names
from lineupkit.runtime import table, work_path
from lineupkit.sources.domain import teams as order_teams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_RAW_NAME = """CASE p_size % 8 WHEN 0 THEN upper(p_brand) WHEN 1 THEN 'Mega ' || p_brand || ' X' WHEN 2 THEN p_brand || ' [Male]' WHEN 3 THEN p_brand || ' [Hisuian Form - Big Breed]'
  WHEN 4 THEN p_brand || ' [Winter Form]' WHEN 5 THEN ' ' || p_brand || '  ' WHEN 6 THEN p_brand || ' [Female]' ELSE 'Rotom [Wash Rotom]' END"""
_RAW_ITEM = "CASE p_size % 9 WHEN 0 THEN 'no item' WHEN 1 THEN NULL WHEN 2 THEN 'dread plate' WHEN 3 THEN 'ASSAULT vest' ELSE lower(p_type) END"


def _forme_sql(x: str) -> str:
    base, held = (f"trim(regexp_extract({x}, '^(.+?)\\s*\\[(.+)\\]\\s*$', {k}))" for k in (1, 2))
    region = " ".join(
        f"WHEN starts_with(lower({held}), '{r} form') THEN '{r.capitalize()} ' || {base} || CASE WHEN starts_with(trim({held}[{len(r) + 6}:]), '- ') THEN ' ' || trim(trim({held}[{len(r) + 6}:])[3:]) ELSE '' END"
        for r in names.REGIONS
    )
    cosmetic = ", ".join(f"'{c}'" for c in [*names.COSMETIC, "male"])
    return f"""CASE WHEN NOT regexp_matches({x}, '^(.+?)\\s*\\[(.+)\\]\\s*$') THEN {x} WHEN lower({held}) IN ({cosmetic}) THEN {base} WHEN lower({held}) = 'female' THEN {base} || ' ♀'
      WHEN lower({base}) = 'rotom' AND contains(lower({held}), 'rotom') THEN {held} {region} WHEN lower({held}) = 'eternal flower' THEN 'Eternal Flower ' || {base}
      WHEN ends_with(lower({held}), ' form') THEN {base} || ' ' || trim({held}[:length({held}) - 5]) ELSE {x} END"""


def _normal_sql(x: str) -> str:
    return f"""nullif(array_to_string(list_transform(string_split_regex(trim(lower({x})), '\\s+'), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda p: upper(p[1]) || p[2:]), '-')), ' '), '')"""


_NAMED = f"""raw AS (SELECT l_orderkey AS team_id, l_linenumber, {_RAW_NAME} AS rname, {_RAW_ITEM} AS ritem FROM lineitem JOIN part ON l_partkey = p_partkey),
n1 AS (SELECT *, {_normal_sql("forme")} AS nm, {_normal_sql("ritem")} AS it FROM (SELECT *, {_forme_sql("rname")} AS forme FROM raw)),
mon AS (SELECT team_id, l_linenumber, CASE WHEN starts_with(nm, 'Mega ') THEN regexp_replace(nm[6:], ' [XYZ]$', '') ELSE nm END AS species,
        CASE WHEN it IN ('None', 'No Item', 'Nothing', 'Null', 'Assault Vest', 'Covert Cloak', 'Safety Goggles') THEN NULL WHEN it = 'Dread Plate' THEN 'Black Glasses' ELSE it END AS item FROM n1),
ok AS (SELECT team_id, string_agg(species || '/' || coalesce(item, '-'), ',' ORDER BY species) AS roster FROM mon GROUP BY team_id
       HAVING count(species) = 4 AND count(DISTINCT species) = 4 AND count(item) > 0),
ent AS (SELECT o_orderkey AS team_id, strftime(o_orderdate, '%Y-%m') AS month, 'P' || o_custkey AS name, o_totalprice AS price,
        row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) - 1 AS pos FROM orders),
idx AS (SELECT ent.*, ok.roster, row_number() OVER (PARTITION BY month ORDER BY pos) - 1 AS team_idx FROM ent JOIN ok USING (team_id))"""


def _entries(s, d, event=None):
    """Raw entries from the tables; the event is the month, or the SQL expression ``event``."""
    parts = table(s, d, "part").select("p_partkey", F.expr(_RAW_NAME).alias("name"), F.expr(_RAW_ITEM).alias("item"), F.array("p_name", F.concat("p_type", F.lit(" protect"))).alias("attacks"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("team_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey")
    decks = lines.groupBy("team_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "name", "item", "attacks"))), lambda x: F.struct(x["name"].alias("name"), x["item"].alias("item"), x["attacks"].alias("attacks"))).alias("decklist"))
    rows = order_teams(s, d).select("team_id", (F.col("month") if event is None else F.expr(event)).alias("tournament_id"), F.concat(F.lit("P"), F.col("player").cast("string")).alias("name"), "price", "placing")
    # In the order of the key, as in a file; neighbours play each other in round 1, and once more under a key that is no number.
    # Places are numbered on keys alone; the opponent is the entry at the place beside.
    place = F.row_number().over(Window.partitionBy("tournament_id").orderBy("team_id")) - 1
    keyed = rows.select("tournament_id", "team_id").withColumn("pos", place).join(rows, ["tournament_id", "team_id"])
    beside = keyed.select("tournament_id", F.col("pos").bitwiseXOR(F.lit(1)).alias("pos"), F.col("name").alias("other_name"), F.col("price").alias("other_price"))
    keyed = keyed.join(beside, ["tournament_id", "pos"], "left")
    result = F.when((F.col("team_id") % 11 == 0) | (F.col("other_price") > F.col("price")), "L").otherwise("W")
    opponent = F.when(F.col("team_id") % 13 == 0, "BYE").otherwise(F.col("other_name"))
    rounds = F.create_map(F.lit("1"), F.struct(opponent.alias("name"), result.alias("result")), F.lit("top"), F.struct(opponent.alias("name"), result.alias("result")))
    out = keyed.select("tournament_id", "pos", "team_id", "name", "price", "placing", rounds.alias("rounds")).join(decks, "team_id", "left")
    record = F.struct(F.lit(1).alias("wins"), F.lit(None).cast("int").alias("losses"), F.lit(None).cast("int").alias("ties"))
    return out.select("tournament_id", F.lit("M-A").alias("regulation"), "pos", "team_id", "name", F.col("placing").cast("int").alias("placing"), record.alias("record"), "decklist", "rounds")


def _roster():
    return F.array_join(F.transform("members", lambda m: F.concat_ws("/", m["species"], F.coalesce(m["item"], F.lit("-")))), ",")


@query("b2_bracket_formes", f"SELECT p_partkey, raw, {_forme_sql('raw')} AS forme FROM (SELECT p_partkey, {_RAW_NAME} AS raw FROM part)")
def bracket_formes(s, d):
    raw = table(s, d, "part").select("p_partkey", F.expr(_RAW_NAME).alias("raw"))
    return raw.withColumn("forme", names.bracket_forme(F.col("raw")))


@query("b3_mega_prefix", f"SELECT p_partkey, CASE WHEN starts_with(n, 'Mega ') THEN regexp_replace(n[6:], ' [XYZ]$', '') ELSE n END AS species FROM (SELECT p_partkey, {_normal_sql('raw')} AS n FROM (SELECT p_partkey, {_RAW_NAME} AS raw FROM part))")
def mega_prefix(s, d):
    return table(s, d, "part").select("p_partkey", names.strip_mega(names.normalize_name(F.expr(_RAW_NAME))).alias("species"))


@query("b4_item_aliases", f"""SELECT p_partkey, CASE WHEN it IN ('None', 'No Item', 'Nothing', 'Null') THEN NULL WHEN it = 'Dread Plate' THEN 'Black Glasses' ELSE it END AS item
       FROM (SELECT p_partkey, {_normal_sql('raw')} AS it FROM (SELECT p_partkey, {_RAW_ITEM} AS raw FROM part))""")
def item_aliases(s, d):
    return table(s, d, "part").select("p_partkey", names.item_name(F.expr(_RAW_ITEM), F.lit("Z")).alias("item"))


@query("b5_illegal_items", f"""SELECT p_partkey, CASE WHEN it IN ('None', 'No Item', 'Nothing', 'Null', 'Assault Vest', 'Covert Cloak', 'Safety Goggles') THEN NULL WHEN it = 'Dread Plate' THEN 'Black Glasses' ELSE it END AS item
       FROM (SELECT p_partkey, {_normal_sql('raw')} AS it FROM (SELECT p_partkey, {_RAW_ITEM} AS raw FROM part))""")
def illegal_items(s, d):
    return table(s, d, "part").select("p_partkey", names.item_name(F.expr(_RAW_ITEM), F.lit("M-A")).alias("item"))


@query("b6_members", f"WITH {_NAMED} SELECT ent.team_id, ok.roster FROM ent LEFT JOIN ok USING (team_id)")
def members(s, d):
    return ingest.parsed(_entries(s, d), 4).select("team_id", _roster().alias("roster"))


@query("b7_teams", f"""WITH {_NAMED} SELECT idx.month AS tournament_id, CAST(team_idx AS INTEGER) AS team_idx, roster, CAST(rank AS INTEGER) AS placing, 1 AS wins, 0 AS losses FROM idx
       JOIN (SELECT team_id, row_number() OVER (PARTITION BY month ORDER BY price DESC, team_id) AS rank FROM ent) USING (team_id)""")
def teams(s, d):
    out = ingest.extract_teams(_entries(s, d), 4)
    return out.select("tournament_id", F.col("team_idx").cast("int").alias("team_idx"), _roster().alias("roster"), "placing", "wins", "losses")


@query("b8_matches", f"""WITH {_NAMED}, say AS (SELECT e.*, CASE WHEN e.team_id % 13 = 0 THEN 'BYE' ELSE o.name END AS other, CASE WHEN e.team_id % 11 = 0 OR o.price > e.price THEN 'L' ELSE 'W' END AS result
         FROM ent e LEFT JOIN ent o ON o.month = e.month AND o.pos = xor(e.pos, 1)),
       one AS (SELECT month, name FROM ent GROUP BY 1, 2 HAVING count(*) = 1),
       v AS (SELECT say.*, idx.team_idx FROM say JOIN idx ON idx.team_id = say.team_id JOIN one ON one.month = say.month AND one.name = say.name)
       SELECT w.month AS tournament_id, 1 AS round, CAST(w.team_idx AS INTEGER) AS winner, CAST(l.team_idx AS INTEGER) AS loser
       FROM v w JOIN v l ON w.month = l.month AND w.other = l.name AND l.other = w.name AND w.result = 'W' AND l.result = 'L' AND w.name <> l.name""")
def matches(s, d):
    out = ingest.extract_matches(_entries(s, d), 4)
    return out.select("tournament_id", "round", F.col("winner").cast("int").alias("winner"), F.col("loser").cast("int").alias("loser"))


@query("b9_singles_names", "SELECT doc_id, contains(lower(coalesce(text, '')), 'singles') AS singles FROM documents")
def singles_names(s, d):
    return table(s, d, "documents").select("doc_id", ingest.is_singles(F.coalesce("text", F.lit(""))).alias("singles"))


@query("b10_protect_ratio", """SELECT strftime(o_orderdate, '%Y-%m') AS tournament_id, count(l_orderkey) AS protect, count(DISTINCT o_orderkey) AS entries,
       count(l_orderkey) / count(DISTINCT o_orderkey) >= 1 AS doubles FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey GROUP BY 1""")
def protect_ratio(s, d):
    return ingest.protect_ratio(_entries(s, d))


@query("b11_size_filter", f"WITH {_NAMED} SELECT month AS tournament_id, count(*) AS teams FROM idx GROUP BY 1 HAVING count(*) >= 3")
def size_filter(s, d):
    return ingest.extract_teams(_entries(s, d), 4).groupBy("tournament_id").agg(F.count("*").alias("teams")).where("teams >= 3")


_RULES = [ingest.Relabel("R2", "1997-01-01", ("M-A",), ("Brand#11",), ("Promo",)), ingest.Relabel("R3", "1996-01-01", ("M-A", "M-B"), ("Wash Rotom",))]


@query("b12_relabelled", f"""WITH {_NAMED}, k AS (SELECT month, max(species = 'Brand#11' OR coalesce(item = 'Promo', false)) AS a, max(species = 'Wash Rotom') AS b FROM idx JOIN mon USING (team_id) GROUP BY month)
       SELECT t.month AS tournament_id, CASE WHEN t.month || '-15' >= '1997-01-01' AND a THEN 'R2' WHEN t.month || '-15' >= '1996-01-01' AND b THEN 'R3' ELSE 'M-A' END AS regulation
       FROM (SELECT DISTINCT month FROM ent) t LEFT JOIN k ON k.month = t.month""")
def relabelled(s, d):
    entries = ingest.parsed_once(_entries(s, d), 4, ["tournament_id", "regulation", "members"])
    events = entries.select("tournament_id", "regulation", F.concat("tournament_id", F.lit("-15T10:00")).alias("date")).distinct()
    return ingest.relabelled(events, entries.where("members IS NOT NULL"), _RULES).select("tournament_id", "regulation")


@query("b13_candidates", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS tournament_id, strftime(o_orderdate, '%Y-%m') >= '1996-01' AS could, strftime(o_orderdate, '%Y-%m') >= '1996-01' AS pending FROM orders""")
def candidates(s, d):
    events = order_teams(s, d).select(F.col("month").alias("tournament_id")).distinct()
    label, date = F.lit("M-A"), F.concat("tournament_id", F.lit("-15"))
    return events.select("tournament_id", ingest.could_match(label, date, "R3", _RULES).alias("could"), ingest.pending_relabel(label, date, _RULES).alias("pending"))


@query("b14_species_sets", f"WITH {_NAMED} SELECT idx.team_id, string_agg(species, ',' ORDER BY species) AS species FROM idx JOIN mon USING (team_id) GROUP BY idx.team_id")
def species_sets(s, d):
    rows = ingest.parsed_once(_entries(s, d), 4, ["team_id", "members"]).where("members IS NOT NULL")
    return rows.select("team_id", F.array_join(ingest.species_sets(F.col("members")), ",").alias("species"))


def _documents(s, d):
    entries = ingest.parsed_once(_entries(s, d), 4)
    meta = entries.groupBy("tournament_id", "regulation").agg(F.count("*").cast("int").alias("players"))
    meta = meta.select("*", F.concat(F.lit("Event "), "tournament_id").alias("name"), F.concat("tournament_id", F.lit("-15")).alias("date"))
    return ingest.documents(meta, ingest.extract_teams(entries, 4), ingest.extract_matches(entries, 4), "in-person")


@query("b15_flattened", f"""WITH {_NAMED} SELECT month AS tournament_id, CAST(team_idx AS INTEGER) AS team_idx, 'in-person' AS type, month || '-15' AS date, roster FROM idx""")
def flattened(s, d):
    """Through the nested document and back to rows."""
    return ingest.observations(_documents(s, d)).select("tournament_id", F.col("team_idx").cast("int").alias("team_idx"), "type", "date", _roster().alias("roster"))


def _cached(s, d, docs=None):
    """The path of a cache written from the tables."""
    path = work_path(s, "cache")
    ingest.write_cache(_documents(s, d) if docs is None else docs, path)
    return path


_EVENTS = f"""WITH {_NAMED}, ev AS (SELECT month AS id, month || '-15' AS date, count(*) AS teams FROM idx GROUP BY month)"""


def _listed(docs):
    return docs.select(F.col("meta.id").alias("id"), F.col("meta.date").alias("date"), F.size("teams").cast("long").alias("teams"))


@query("a9_cache_scan", f"{_EVENTS} SELECT id, date, teams FROM ev WHERE teams >= 3")
def cache_scan(s, d):
    """Events written as JSON by regulation and read back, those of three teams at least."""
    return _listed(ingest.read_cache(s, _cached(s, d), "M-A", "in-person", 3))


@query("a10_cached_event", f"{_EVENTS} SELECT id, date, teams FROM ev WHERE id = (SELECT max(id) FROM ev)")
def cached_event(s, d):
    """One event of the cache by its id."""
    docs = ingest.read_cache(s, _cached(s, d), least=0)
    last = docs.agg(F.max("meta.id")).first()[0]
    return _listed(ingest.cached(docs, last or ""))


@query("a11_version_gate", f"""{_EVENTS}, vr AS (SELECT *, nullif(CAST(right(id, 2) AS INTEGER) % 4, 0) AS version, CAST(left(id, 4) AS INTEGER) % 2 = 0 AS online FROM ev)
 SELECT id, date, teams FROM vr WHERE coalesce(version, 1) >= CASE WHEN online THEN 2 ELSE 3 END""")
def version_gate(s, d):
    """Documents of several versions, some without one and some without a type: only those new enough for their type are read."""
    month, year = F.substring("meta.id", -2, 2).cast("int"), F.substring("meta.id", 1, 4).cast("int")
    docs = _documents(s, d).withColumn("version", F.nullif(month % 4, F.lit(0))).withColumn("type", F.when(year % 2 != 0, F.col("type")))
    return _listed(ingest.read_cache(s, _cached(s, d, docs), least=0))


#: Files hold at most so many entries, whatever the size of the tables: an event is a stretch of keys, its day the first order's.
PER_FILE = 512
_EVENT = f"concat('E', team_id DIV {PER_FILE})"
_IN_FILES = _NAMED.replace("strftime(o_orderdate, '%Y-%m')", f"'E' || (o_orderkey // {PER_FILE})")
_STEMS = f"st AS (SELECT 'E' || (o_orderkey // {PER_FILE}) AS month, 'E' || (o_orderkey // {PER_FILE}) || '_' || strftime(min(o_orderdate), '%Y-%m-%d') AS stem, strftime(min(o_orderdate), '%Y-%m-%d') AS date, count(*) AS players FROM orders GROUP BY 1, o_orderkey // {PER_FILE})"


def _landed(s, texts, label):
    """``texts`` (value, of, stem), one file each, written and read back as (value, of, stem, path)."""
    path = work_path(s, label)
    texts.write.partitionBy("of", "stem").text(path)
    files = s.read.text(path, wholetext=True)
    return files.select("value", "of", "stem", F.concat("of", F.lit("/"), "stem", F.lit(".json")).alias("path"))


def _files(s, d, entry, entries):
    """Each event's entries, in order, as one JSON list in a file named by event and day."""
    first = order_teams(s, d).select(F.expr(_EVENT).alias("tournament_id"), "day").groupBy("tournament_id").agg(F.min("day").alias("day"))
    texts = entries.groupBy("tournament_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("pos", F.to_json(entry).alias("e"))))["e"], ","), F.lit("]")).alias("value")).join(first, "tournament_id")
    return _landed(s, texts.select("value", F.lit("M-A").alias("of"), F.concat_ws("_", "tournament_id", F.col("day").cast("string")).alias("stem")), "standings")


_MATCHES = SQL["b8_matches"].replace("strftime(o_orderdate, '%Y-%m')", f"'E' || (o_orderkey // {PER_FILE})")


@query("a5_imported_events", f"""WITH {_IN_FILES}, {_STEMS}, mt AS ({_MATCHES}), tn AS (SELECT month, count(*) AS teams FROM idx GROUP BY month), mn AS (SELECT tournament_id AS month, count(*) AS matches FROM mt GROUP BY 1)
 SELECT 'local_' || stem AS id, date, 'M-A' AS regulation, CAST(players AS INTEGER) AS players, teams, coalesce(matches, 0) AS matches, 0 AS again FROM st JOIN tn USING (month) LEFT JOIN mn USING (month)""")
def imported_events(s, d):
    """Files of standings imported into an empty cache, and read from there; ``again`` is what a second import wrote."""
    entries = _entries(s, d, _EVENT)
    files = _files(s, d, F.struct("name", "placing", "record", "decklist", "rounds"), entries)
    cache = work_path(s, "imports")
    ingest.import_entries(ingest.standings_of(files), cache, size=4)
    again = ingest.import_entries(ingest.standings_of(files), cache, size=4).count()
    docs = ingest.read_cache(s, cache, "M-A", "in-person", 1)
    size = lambda c: F.size(c).cast("long").alias(c)
    return docs.select("meta.id", "meta.date", "meta.regulation", "meta.players", size("teams"), size("matches"), F.lit(again).alias("again"))


@query("a6_file_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def file_dates(s, d):
    """Days in names of several forms; a day that is not at the end, or has no separator before it, is none."""
    day = F.to_date("o_orderdate").cast("string")
    key = F.col("o_orderkey")
    stem = F.when(key % 4 == 0, F.concat(F.lit("cup"), day)).when(key % 4 == 1, F.concat(F.lit("cup_"), day, F.lit("_x")))
    stem = stem.when(key % 4 == 2, F.concat(F.lit("cup-"), F.translate(day, "-", "_"))).otherwise(F.concat(F.lit("cup_2001-01-01_"), day))
    return table(s, d, "orders").select("o_orderkey", ingest.file_date(stem).alias("date"))


@query("a7_team_sheets", f"""WITH {_IN_FILES}, {_STEMS} SELECT 'local_' || stem AS tournament_id, name, team_id % 1000 AS placing, idx.roster FROM (SELECT month, team_id, name, roster FROM idx) idx JOIN st USING (month) WHERE team_id % 3 <> 0 AND team_id % 7 <> 0
 UNION ALL SELECT 'local_' || stem, name, NULL, idx.roster FROM (SELECT month, team_id, name, roster FROM idx) idx JOIN st USING (month) WHERE team_id % 3 <> 0 AND team_id % 7 = 0""")
def team_sheets(s, d):
    """Team sheets by place: one division alone, a placing that is no number is none."""
    key = F.col("team_id")
    gap = F.lit(None).cast("string")
    sheet = F.transform("decklist", lambda m: F.array(gap, gap, gap, gap, F.lit("x"), m["name"], m["item"]))
    placing = F.when(key % 7 == 0, F.lit("DQ")).otherwise((key % 1000).cast("string"))
    row = F.struct(F.col("name").alias("n"), F.when(key % 3 == 0, "S").otherwise("M").alias("d"), placing.alias("#"), F.coalesce(sheet, F.array().cast("array<array<string>>")).alias("tl"))
    landed = ingest.standings_of(_files(s, d, row, _entries(s, d, _EVENT)))
    out = ingest.parsed_once(landed, 4, ["tournament_id", "name", "placing", "members"]).where("members IS NOT NULL")
    return out.select("tournament_id", "name", F.col("placing").cast("long").alias("placing"), _roster().alias("roster"))


_VOTES = {"dear": "o_totalprice > 100000", "urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "player": "o_custkey % 2 = 1", "key": "o_orderkey % 2 = 1"}


@query("a13_votes", f"""SELECT 'E' || (o_orderkey // {PER_FILE}) AS stem, row_number() OVER (PARTITION BY o_orderkey // {PER_FILE} ORDER BY o_orderkey) AS row_no, unnest({list(_VOTES)}) AS feature, unnest([{', '.join(f'({x})::INT' for x in _VOTES.values())}]) AS vote FROM orders""")
def votes(s, d):
    """Texts of one row of digits an order, with blank lines between and blanks around, written and read back."""
    digits = F.concat(*[F.expr(x).cast("int").cast("string") for x in _VOTES.values()])
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("\n  "), digits, F.lit(" \n"))).otherwise(digits)
    stem = F.concat(F.lit("E"), F.floor(F.col("o_orderkey") / PER_FILE).cast("string"))
    lines = table(s, d, "orders").select(stem.alias("stem"), "o_orderkey", line.alias("line"))
    texts = lines.groupBy("stem").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", "line")))["line"], "\n").alias("value"))
    landed = _landed(s, texts.select("value", F.lit("votes").alias("of"), "stem"), "votes").select("value", "stem")
    return ingest.votes_of(landed, list(_VOTES))


@query("b16_pair_parts", "SELECT DISTINCT p_brand || ' @ ' || p_type AS feature, p_brand AS species, p_type AS item FROM part")
def pair_parts(s, d):
    features = table(s, d, "part").select(names.format_pair(F.col("p_brand"), F.col("p_type")).alias("feature")).distinct()
    species, item = names.pair_parts(F.col("feature"))
    return features.select("feature", species.alias("species"), item.alias("item"))


@query("b17_slugs", """SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM part""")
def slugs(s, d):
    return table(s, d, "part").select("p_partkey", names.slugify(F.concat("p_brand", F.lit(" "), "p_name", F.lit("!"))).alias("slug"))
