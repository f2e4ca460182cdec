"""From raw standings to the corpus: rosters, outcomes, matches, filters, and the document cache.

Entries are one row a player: (tournament_id, regulation, pos, name, placing, record, decklist, rounds); ``pos`` counts from 0
in the order of the file.  All steps are array functions within a row or joins on the tournament.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.operators.evaluation import running_sums
from lineupkit.operators.names import item_name, let, species_name, strip_blanks
from lineupkit.runtime import path_exists, stash

TEAM_SIZE, LEAST_TEAMS, LEAST_PROTECT = 6, 64, 1.0
# Version written, and the least version of each type that is read.
VERSION, LEAST_VERSION = 3, {"limitless": 2, "in-person": 3}
ENTRY = (
    "struct<name:string,placing:int,record:struct<wins:int,losses:int,ties:int>,"
    "decklist:array<struct<name:string,item:string,attacks:array<string>>>,rounds:map<string,struct<name:string,result:string>>,"
    "n:string,d:string,`#`:string,tl:array<array<string>>>"
)


@dataclass(frozen=True)
class Relabel:
    """A rule: events of a stale label from a day on belong to ``target`` if a roster has a marker."""

    target: str
    start: str
    labels: tuple[str, ...]
    species: tuple[str, ...] = ()
    items: tuple[str, ...] = field(default=())


# Fixed values.
RELABELS = [Relabel("M-C", "2026-09-09", ("M-B", "CUSTOM"), ("Rillaboom", "Indeedee", "Indeedee ♀", "Salamence", "Golisopod", "Baxcalibur"))]


def file_date(stem: Column) -> Column:
    """The day at the end of a file's name, its parts after - or _, as year-month-day; empty where there is none, null for null."""
    day = F.regexp_extract_all(stem, F.lit(r"[_-](\d{4})[_-](\d{2})[_-](\d{2})$"), F.lit(0))
    return F.regexp_replace(F.substring(F.coalesce(F.get(day, F.lit(0)), F.when(stem.isNotNull(), "")), F.lit(2), F.lit(10)), "_", "-")


def read_standings(spark: SparkSession, local_dir: str) -> DataFrame:
    """Entries of ``<regulation>/<id>_<date>.json`` files, as ``standings_of`` gives them."""
    return standings_of(spark.read.text(f"{local_dir}/*/*.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


def standings_of(files: DataFrame) -> DataFrame:
    """Entries of landed files (value, path), with tournament_id, regulation, date and players.

    Each file is one JSON list; what is no list is skipped.  Team-sheet exports (rows with ``tl``) are brought to the same
    shape: division M alone, species and item by place, ``#`` as the placing.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    parsed = files.select(
        F.concat(F.lit("local_"), stem).alias("tournament_id"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("regulation"),
        file_date(stem).alias("date"), F.from_json("value", f"array<{ENTRY}>").alias("all_"),
    )
    sheet = F.get("all_", F.lit(0))["tl"].isNotNull()
    kept = F.when(sheet, F.filter("all_", lambda e: e["d"] == "M")).otherwise(F.col("all_"))
    rows = parsed.select("tournament_id", "regulation", "date", F.size(kept).alias("players"), sheet.alias("sheet_"), F.posexplode(kept).alias("pos", "e"))
    decklist = F.transform("e.tl", lambda r: F.struct(F.get(r, F.lit(5)).alias("name"), F.get(r, F.lit(6)).alias("item"), F.lit(None).cast("array<string>").alias("attacks")))
    pick = lambda a, b: F.when(F.coalesce("sheet_", F.lit(False)), a).otherwise(b)
    return rows.select(
        "tournament_id", "regulation", "date", "players", "pos", pick(F.col("e.n"), F.col("e.name")).alias("name"),
        pick(F.expr("try_cast(e.`#` AS int)"), F.col("e.placing")).alias("placing"), "e.record", pick(decklist, F.col("e.decklist")).alias("decklist"), "e.rounds",
    )


def members_of(decklist: Column, regulation: Column, size: int = TEAM_SIZE) -> Column:
    """The roster (species, item) in order, or null: not ``size`` named members, a species twice, or no item at all."""
    named = F.transform(decklist, lambda m: F.struct(species_name(m["name"]).alias("species"), item_name(m["item"], regulation).alias("item")))

    def whole(kept: Column) -> Column:
        fine = (F.size(kept) == size) & (F.size(F.array_distinct(kept["species"])) == size) & F.exists(kept, lambda m: m["item"].isNotNull())
        return F.when(fine, F.array_sort(kept))

    return let(F.filter(named, lambda m: m["species"].isNotNull()), whole)


def parsed(entries: DataFrame, size: int = TEAM_SIZE) -> DataFrame:
    """``entries`` with ``members`` and, for valid ones, ``team_idx`` (0 onwards in the order of ``pos``); parsed ones stay as they are."""
    if {"members", "team_idx"} <= set(entries.columns):
        return entries
    rows = entries.withColumn("members", members_of(F.col("decklist"), F.col("regulation"), size))
    valid = F.col("members").isNotNull()
    # An event is a few thousand entries by its nature.
    before = F.sum(valid.cast("int")).over(Window.partitionBy("tournament_id").orderBy("pos"))
    return rows.withColumn("team_idx", F.when(valid, before - 1))


def parsed_once(entries: DataFrame, size: int = TEAM_SIZE, columns: list[str] | None = None) -> DataFrame:
    """``parsed`` without the decklist, or its ``columns``, written and read back: a filter on the members would parse every list once more."""
    rows = parsed(entries, size)
    return stash(rows.select(*columns) if columns else rows.drop("decklist"), "parsed")


def extract_teams(entries: DataFrame, size: int = TEAM_SIZE) -> DataFrame:
    """Valid rosters with their outcome; a missing record is 0-0-0, a placing that is no whole number null."""
    record = lambda k: F.coalesce(F.col(f"record.{k}"), F.lit(0)).alias(k)
    rows = parsed(entries, size).where("members IS NOT NULL")
    return rows.select("tournament_id", "team_idx", "members", "placing", *map(record, ("wins", "losses", "ties")))


def extract_matches(entries: DataFrame, size: int = TEAM_SIZE) -> DataFrame:
    """(tournament_id, round, winner, loser): pairings that both valid entries report, one W and one L, names unique."""
    # Written once: names, winners and losers are all read from it.
    rows = parsed(entries, size).select("tournament_id", F.coalesce("name", F.lit("")).alias("name"), F.col("members").isNotNull().alias("valid_"), "team_idx", "rounds")
    rows = rows if "decklist" not in entries.columns else stash(rows, "parsed-entries")
    once = rows.groupBy("tournament_id", "name").agg(F.count("*").alias("n_")).where("n_ = 1").drop("n_")
    told = rows.where("valid_").join(once, ["tournament_id", "name"])
    told = told.select("tournament_id", "name", "team_idx", F.explode("rounds").alias("round_key", "played"))
    told = told.select("tournament_id", "name", "team_idx", "round_key", F.col("played.name").alias("other"), F.col("played.result").alias("result"))
    told = told.where(F.col("result").isin("W", "L") & (F.col("other") != F.col("name")))
    won, lost = told.where("result = 'W'"), told.where("result = 'L'")
    back = lost.select("tournament_id", "round_key", F.col("name").alias("other"), F.col("other").alias("name"), F.col("team_idx").alias("loser"))
    met = won.select("tournament_id", "round_key", "name", "other", F.col("team_idx").alias("winner")).join(back, ["tournament_id", "round_key", "name", "other"])
    number = F.expr("try_cast(trim(round_key) AS int)")
    met = met.withColumn("round", number).where("round IS NOT NULL").withColumns({"low_": F.least("winner", "loser"), "high_": F.greatest("winner", "loser")})
    # Keys such as 1 and 01 are one round.
    first = met.groupBy("tournament_id", "round", "low_", "high_").agg(F.min_by(F.struct("winner", "loser"), "round_key").alias("m_"))
    return first.select("tournament_id", "round", "m_.winner", "m_.loser")


def is_singles(name: Column) -> Column:
    return F.lower(name).contains("singles")


def protect_ratio(entries: DataFrame) -> DataFrame:
    """(tournament_id, protect, entries, doubles): uses of protect over entries, at least one a player for doubles."""
    moves = F.flatten(F.transform(F.coalesce("decklist", F.array()), lambda m: F.coalesce(m["attacks"], F.array())))
    hits = F.size(F.filter(moves, lambda a: F.coalesce(F.lower(a).contains("protect"), F.lit(False))))
    sums = entries.select("tournament_id", hits.alias("h_")).groupBy("tournament_id").agg(F.sum("h_").alias("protect"), F.count("*").alias("entries"))
    return sums.withColumn("doubles", F.col("protect") / F.col("entries") >= LEAST_PROTECT)


def _pending(rule: Relabel, label: Column, date: Column) -> Column:
    return label.isin(*rule.labels) & (F.substring(F.coalesce(date, F.lit("")), 1, 10) >= rule.start)


def could_match(label: Column, date: Column, target: str, rules: list[Relabel] = RELABELS) -> Column:
    """Whether an event can turn out to be of ``target`` before its rosters are known."""
    out = label == target
    for rule in (r for r in rules if r.target == target):
        out = out | _pending(rule, label, date)
    return F.coalesce(out, F.lit(False))


def pending_relabel(label: Column, date: Column, rules: list[Relabel] = RELABELS) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(_pending(rule, label, date), F.lit(False))
    return out


def relabelled(tournaments: DataFrame, teams: DataFrame, rules: list[Relabel] = RELABELS) -> DataFrame:
    """``tournaments`` (tournament_id, regulation, date, ...) with their true ``regulation``: the first rule that holds."""

    def marked(rule: Relabel) -> Column:
        return F.exists("members", lambda m: m["species"].isin(*rule.species) | F.coalesce(m["item"].isin(*rule.items), F.lit(False)))

    marks = teams.groupBy("tournament_id").agg(*[F.max(marked(r)).alias(f"mark{k}_") for k, r in enumerate(rules)])
    rows = tournaments.join(marks, "tournament_id", "left")
    label = F.lit(None).cast("string")
    for k, rule in reversed(list(enumerate(rules))):
        holds = F.coalesce(_pending(rule, F.col("regulation"), F.col("date")) & F.col(f"mark{k}_"), F.lit(False))
        label = F.when(holds, rule.target).otherwise(label)
    return rows.withColumn("regulation", F.coalesce(label, "regulation")).drop(*[f"mark{k}_" for k in range(len(rules))])


def documents(meta: DataFrame, teams: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    """The cache's form, one row a tournament: version, type, meta, teams in order, matches.  Without teams no row."""
    roster = F.transform("members", lambda m: F.array(m["species"], m["item"]))
    team = F.struct("team_idx", F.struct(roster.alias("members"), "placing", F.array("wins", "losses", "ties").alias("record")).alias("team"))
    held = teams.groupBy("tournament_id").agg(F.sort_array(F.collect_list(team))["team"].alias("teams"))
    played = matches.groupBy("tournament_id").agg(F.sort_array(F.collect_list(F.array("round", "winner", "loser"))).alias("matches"))
    rows = meta.join(held, "tournament_id").join(played, "tournament_id", "left")
    about = F.struct(F.col("tournament_id").alias("id"), "name", "date", "regulation", "players").alias("meta")
    return rows.select(F.lit(VERSION).alias("version"), F.lit(kind).alias("type"), about, "teams", F.coalesce("matches", F.array().cast("array<array<int>>")).alias("matches"))


DOCUMENT = (
    "version int, type string, meta struct<id:string,name:string,date:string,regulation:string,players:int>, "
    "teams array<struct<members:array<array<string>>,placing:int,record:array<int>>>, matches array<array<int>>"
)


def write_cache(docs: DataFrame, path: str) -> None:
    """Append tournaments as JSON, by regulation, so that a scan of one regulation reads no other."""
    docs.withColumn("of", F.col("meta.regulation")).write.mode("append").partitionBy("of").json(path)


def version_ok(version: Column, kind: Column) -> Column:
    """At least the least version of the type; a missing version is 1, a missing type the online one."""
    least = F.create_map(*[F.lit(x) for pair in LEAST_VERSION.items() for x in pair])
    return F.coalesce(F.coalesce(version, F.lit(1)) >= F.try_element_at(least, F.coalesce(kind, F.lit("limitless"))), F.lit(False))


def read_cache(spark: SparkSession, path: str, regulation: str | None = None, kind: str | None = None, least: int = LEAST_TEAMS) -> DataFrame:
    """Tournaments of the cache that pass version, type, regulation, name and size; unreadable lines are left out."""
    docs = spark.read.schema(DOCUMENT + ", of string").option("mode", "DROPMALFORMED").json(path)
    docs = docs.where(F.col("of") == regulation) if regulation is not None else docs
    docs = docs.where(version_ok(F.col("version"), F.col("type"))).withColumn("type", F.coalesce("type", F.lit("limitless")))
    docs = docs.where(F.col("type") == kind) if kind is not None else docs
    return docs.where(~is_singles(F.col("meta.name")) & (F.size("teams") >= least)).drop("of").orderBy("meta.date", "meta.id")


def cached(docs: DataFrame, tournament_id: str) -> DataFrame:
    """One tournament of the cache, or no row where it is missing or outdated."""
    return docs.where((F.col("meta.id") == tournament_id) & version_ok(F.col("version"), F.col("type")))


def import_in_person(spark: SparkSession, local_dir: str, cache: str, have: DataFrame | None = None, size: int = TEAM_SIZE) -> DataFrame:
    """New files of ``local_dir`` as documents, appended to the cache; events in ``have`` (ids), or else in the cache, are left out.

    What is returned has been written and stays the same, however the cache grows.  A second call writes nothing.
    """
    return import_entries(read_standings(spark, local_dir), cache, have, size)


def import_entries(entries: DataFrame, cache: str, have: DataFrame | None = None, size: int = TEAM_SIZE) -> DataFrame:
    """``import_in_person`` for entries that ``standings_of`` gave."""
    spark = entries.sparkSession
    if have is None and path_exists(spark, cache):
        have = spark.read.schema(DOCUMENT + ", of string").json(cache).select("meta.id")
    if have is not None:
        entries = entries.join(have.toDF("tournament_id"), "tournament_id", "left_anti")
    entries = parsed_once(entries, size)
    meta = entries.groupBy("tournament_id", "regulation", "date").agg(F.max("players").alias("players"))
    meta = meta.withColumn("name", F.expr("substring(tournament_id, 7)"))
    out = stash(documents(meta, extract_teams(entries, size), extract_matches(entries, size), "in-person"), "imported")
    if not out.isEmpty():
        write_cache(out, cache)
    return out


def observations(docs: DataFrame) -> DataFrame:
    """One row a team: tournament_id, team_idx, type, date, members, placing, wins, losses, ties."""
    rows = docs.select(F.col("meta.id").alias("tournament_id"), "type", F.col("meta.date").alias("date"), F.posexplode("teams").alias("team_idx", "t"))
    members = F.transform("t.members", lambda m: F.struct(m[0].alias("species"), m[1].alias("item")))
    return rows.select("tournament_id", "team_idx", "type", "date", members.alias("members"), "t.placing", *[F.col("t.record")[k].alias(n) for k, n in enumerate(("wins", "losses", "ties"))])


def match_observations(docs: DataFrame) -> DataFrame:
    """One row a match with both rosters."""
    rows = docs.select(F.col("meta.id").alias("tournament_id"), F.col("meta.date").alias("date"), "teams", F.explode("matches").alias("m"))
    roster = lambda k: F.get("teams", F.col("m")[k])["members"]
    return rows.select("tournament_id", "date", F.col("m")[0].alias("round"), roster(1).alias("winner"), roster(2).alias("loser"))


def species_sets(members: Column) -> Column:
    """The species of a roster, in order."""
    return F.array_sort(F.transform(members, lambda m: m["species"]))


def read_votes(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(row_no, feature, vote) of a text with one row of 0 and 1 a case, a digit a name; blank lines do not count, another width is an error.

    ``row_no`` counts from 1 in the order of the file, which is short by its nature and read whole.
    """
    return votes_of(spark.read.text(path, wholetext=True), names)


def votes_of(texts: DataFrame, names: list[str]) -> DataFrame:
    """``read_votes`` for landed texts (value, and columns that are kept): row_no counts within each text; a null text has no rows."""
    kept = [c for c in texts.columns if c != "value"]
    lines = F.filter(F.transform(F.split("value", "\n"), strip_blanks), lambda x: x != "")
    rows = texts.select(*kept, F.posexplode(lines).alias("pos", "line"))
    wrong = F.raise_error(F.concat(F.lit(f"a row must have {len(names)} digits: "), F.col("line")))
    checked = F.when(F.col("line").rlike(f"^[01]{{{len(names)}}}$"), F.col("line")).otherwise(wrong.cast("string"))
    votes = [F.struct(F.lit(n).alias("feature"), F.substring(checked, k + 1, 1).cast("int").alias("vote")) for k, n in enumerate(names)]
    return rows.select(*kept, (F.col("pos") + 1).cast("long").alias("row_no"), F.inline(F.array(*votes)))


def walk_pages(catalog: DataFrame, candidate: Column, keep: Column, max_teams: int, start_page: int = 0, page_size: int = 1_000) -> DataFrame:
    """Entries that a walk over landed catalog pages takes, with ``before``, the teams taken until then.

    ``catalog`` (page, pos, id, teams, ...).  An id counts where it stands first, from ``start_page`` on; ``candidate`` entries
    are new to the walk, of these it takes those that ``keep``.  The walk ends before the first page that is missing or has
    no new candidate, and after the entry that brings the teams to ``max_teams``.  Nothing is put in order as a whole: a page lies in the
    unbroken prefix if as many good pages as its number come up to it, and both running counts go by stretches.
    Null ids, pages and places are left out, null teams count 0; ``pos`` is below ``page_size``.
    """
    rows = catalog.where((F.col("page") >= start_page) & F.col("pos").isNotNull() & F.col("id").isNotNull())
    first = rows.groupBy(F.col("id").alias("id_")).agg(F.min(F.struct("page", "pos")).alias("at_"))
    fresh = rows.join(first, (F.col("id") == F.col("id_")) & (F.col("page") == F.col("at_.page")) & (F.col("pos") == F.col("at_.pos"))).where(candidate)
    fresh = stash(fresh.drop("id_", "at_"), "walk")
    good = fresh.select("page").distinct().withColumn("one_", F.lit(1))
    counted = running_sums(good, "page", ["one_"], 10_000)
    last = counted.where(F.col("one__below") == F.col("page") - start_page).agg(F.max("page").alias("last_"))
    taken = fresh.where(keep).crossJoin(F.broadcast(last)).where("page <= last_").drop("last_")
    taken = taken.withColumn("place_", F.col("page") * page_size + F.col("pos")).withColumn("held_", F.coalesce("teams", F.lit(0)).cast("long"))
    # One row a place for the running sum; entries of one place and different ids share it.
    sums = running_sums(taken.groupBy("place_").agg(F.sum("held_").alias("held_")), "place_", ["held_"], 100_000)
    out = taken.drop("held_").join(sums.select("place_", F.col("held__below").cast("long").alias("before")), "place_")
    return out.where(F.col("before") < max_teams).drop("place_")


def deactivate_tracks(tracks: DataFrame, inactive: list[int]) -> DataFrame:
    """A model's tracks (place, name, unique) with the flag ``unique`` of the chosen places cleared; other places change nothing."""
    return tracks.withColumn("unique", F.when(F.col("place").isin(*inactive), False).otherwise(F.col("unique"))) if inactive else tracks
