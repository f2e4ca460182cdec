"""Pasted teams: parsing, resolving against a vocabulary, matching, export, and share tokens.

A vocabulary here is (feature, species, item, m).  Pastes are short texts, so each is worked on within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.operators.names import let, slugify, species_slug, strip_blanks

TEAM_SIZE = 6
# Slugs of pasted names that stand for another, and former codes of models.
PASTE_ALIASES = {"floette-eternal": "floette"}
FORMER_CODES = {
    "s": "reg-m-a", "si": "reg-m-a", "reg-m-a-species": "reg-m-a", "reg-m-a-species-item": "reg-m-a", "reg-m-a-species-item-weighted": "reg-m-a",
    "reg-m-b-experimental": "reg-m-b", "reg-m-b-species-item-boltzmann": "reg-m-b",
}


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def parse(text: Column) -> Column:
    """array<struct<species, item, species_slug, item_slug>> of a paste, in order.

    Blank lines part the blocks; a block's first line that is not blank says all: ``Species @ Item``, ``Nickname (Species) @ Item``,
    a gender mark behind the name.  A block without a species is left out; null gives null.
    """

    def line(block: Column) -> Column:
        return F.get(F.filter(F.transform(F.split(block, "\n"), strip_blanks), lambda x: x != ""), F.lit(0))

    # What is named more than once is bound, so that it is computed once a block.
    def unmarked(name: Column) -> Column:
        return strip_blanks(F.regexp_replace(name, r"(?iU)\s*\((?:M|F)\)\s*$", ""))

    def species_of(name: Column) -> Column:
        return strip_blanks(let(F.regexp_extract(name, r"(?U)^.*\s+\(([^)]+)\)\s*$", 1), lambda inner: F.when(inner != "", inner).otherwise(name)))

    def mon(row: Column) -> Column:
        cut = row.contains(" @ ")
        item = let(strip_blanks(F.regexp_extract(row, r"^.* @ (.*)$", 1)), lambda x: F.when(x != "", x))
        name = strip_blanks(F.when(cut, F.regexp_extract(row, r"^(.*) @ .*$", 1)).otherwise(row))
        return F.struct(let(unmarked(name), species_of).alias("species"), F.when(cut, item).alias("item"))

    def slug_of(species: Column) -> Column:
        slug = species_slug(F.regexp_replace(species, r"(?i)-Mega(-[XYZ])?$", ""))
        return let(slug, lambda s: F.coalesce(_looked_up(s, PASTE_ALIASES), s))

    def named(m: Column) -> Column:
        return F.struct(m["species"].alias("species"), m["item"].alias("item"), slug_of(m["species"]).alias("species_slug"), slugify(m["item"]).alias("item_slug"))

    lines = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n", -1), line), lambda x: x.isNotNull())
    return F.transform(F.filter(F.transform(lines, mon), lambda m: m["species"] != ""), named)


def parsed_mons(pastes: DataFrame) -> DataFrame:
    """(paste_id, pos, species, item, species_slug, item_slug) of (paste_id, text); a paste without members has one row of nulls.

    An outer explode: before an inner one Spark puts a filter on the array, which parses every text once more.
    """
    rows = pastes.select("paste_id", F.posexplode_outer(parse(F.col("text"))).alias("pos", "m_"))
    return rows.select("paste_id", "pos", "m_.species", "m_.item", "m_.species_slug", "m_.item_slug")


def slug_index(vocab: DataFrame) -> DataFrame:
    """The vocabulary with slugs and ``place``: 1 for the largest marginal of its species slug, ties by feature."""
    named = vocab.select("feature", "item", "m", species_slug(F.col("species")).alias("species_slug"), slugify(F.col("item")).alias("item_slug"))
    order = Window.partitionBy("species_slug").orderBy(F.desc(F.round("m", 12)), "feature")
    return named.withColumn("place", F.row_number().over(order))


def resolve(mons: DataFrame, vocab: DataFrame) -> DataFrame:
    """``mons`` (..., species, item, species_slug, item_slug) with ``feature``, ``feature_item`` and ``warning``.

    Without an item the best feature of the species stands; with one only that item does, never another build.
    """
    index = slug_index(vocab)
    best = index.where("place = 1").select("species_slug", F.col("feature").alias("best_"), F.col("item").alias("best_item_"))
    exact = index.groupBy("species_slug", "item_slug").agg(F.min_by(F.struct("feature", "item"), "place").alias("e_"))
    rows = mons.join(best, "species_slug", "left").join(exact, ["species_slug", "item_slug"], "left")
    asked = F.col("item_slug").isNotNull()
    label = F.when(asked & F.col("best_").isNotNull(), F.concat("species", F.lit(" @ "), "item")).otherwise(F.col("species"))
    feature = F.when(asked, F.col("e_.feature")).otherwise(F.col("best_"))
    warning = F.when(feature.isNull(), F.concat(label, F.lit(" is not in this model, so it was skipped.")))
    return rows.select(*mons.columns, feature.alias("feature"), F.when(asked, F.col("e_.item")).otherwise(F.col("best_item_")).alias("feature_item"), warning.alias("warning"))


def match(pastes: DataFrame, vocab: DataFrame, size: int = TEAM_SIZE) -> DataFrame:
    """(paste_id, features, warnings, error) of (paste_id, text): the first ``size`` resolved members with species and items used once.

    A repeated species goes silently, a repeated item with a warning; ``error`` tells an empty paste and one that matches nothing.
    """
    rows = resolve(parsed_mons(pastes), vocab)
    # A paste's rows are as few as its blocks; an empty one has none but its row of nulls.
    member = F.when(F.col("pos").isNotNull(), F.struct("pos", "species", "species_slug", "feature", "feature_item", "warning"))
    mons = rows.groupBy("paste_id").agg(F.sort_array(F.collect_list(member)).alias("r_"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("features"), none.alias("slugs"), none.alias("items"), none.alias("holders"), none.alias("warnings"))

    def step(now: Column, r: Column) -> Column:
        full = F.size(now["features"]) >= size
        repeated = F.array_contains(now["slugs"], r["species_slug"])
        at = F.coalesce(F.array_position(now["items"], r["feature_item"]), F.lit(0))
        holder = F.get(now["holders"], (at - 1).cast("int"))
        twice = F.concat(r["species"], F.lit(" also holds "), r["feature_item"], F.lit(" ("), holder, F.lit(" has it), so it was skipped."))
        known = ~full & r["feature"].isNotNull() & ~repeated
        taken, held = known & (at == 0), r["feature_item"].isNotNull()
        told = F.when(~full & r["feature"].isNull(), r["warning"]).when(known & (at > 0), twice)
        add = lambda name, value, when: F.when(when, F.array_append(now[name], value)).otherwise(now[name]).alias(name)
        return F.struct(
            add("features", r["feature"], taken), add("slugs", r["species_slug"], taken), add("items", r["feature_item"], taken & held),
            add("holders", r["species"], taken & held), add("warnings", told, told.isNotNull()),
        )

    found = mons.select("paste_id", F.size("r_").alias("size_"), F.explode_outer(F.array(F.aggregate("r_", start, step))).alias("f_"))
    error = F.when(F.col("size_") < 1, "The paste is empty.").when(F.size("f_.features") == 0, "Nothing of the paste matched this model.")
    return found.select("paste_id", F.col("f_.features").alias("features"), F.col("f_.warnings").alias("warnings"), error.alias("error"))


def export(members: Column) -> Column:
    """A paste of array<struct<species, item>>, one block a member; a missing item and None have no item part."""

    def block(m: Column) -> Column:
        held = F.when(m["item"] != "None", m["item"])
        return F.concat(species_slug(m["species"]), F.coalesce(F.concat(F.lit(" @ "), held), F.lit("")))

    return F.array_join(F.transform(members, block), "\n\n")


def share_token(model: Column, members: Column, sites: Column) -> Column:
    """``model.mons``: members (species, item) as ``species~item``, then pinned sites as bare species, joined by ``_``."""
    full = F.transform(members, lambda m: F.concat(species_slug(m["species"]), F.coalesce(F.concat(F.lit("~"), slugify(m["item"])), F.lit(""))))
    return F.concat(model, F.lit("."), F.array_join(F.concat(full, F.transform(sites, species_slug)), "_"))


def read_token(token: Column) -> Column:
    """struct<model_id, mons: array<struct<species_slug, item_slug>>> of a token, or null where it is malformed.

    Former model codes are translated, and a segment of digits before the mons is dropped.
    """
    parts = F.split(token, r"\.", -1)
    code, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    model = F.coalesce(_looked_up(code, FORMER_CODES), F.when(code.rlike("^[a-z0-9_-]+$"), code))
    from_ = F.when(second.rlike(r"^\d+$"), 3).otherwise(2)
    mons = F.filter(F.split(F.array_join(F.slice(parts, from_, F.size(parts)), "."), "_"), lambda x: x != "")
    item = lambda x: F.when(x.contains("~"), F.regexp_extract(x, "^[^~]*~(.*)$", 1))
    named = F.transform(mons, lambda x: F.struct(F.substring_index(x, "~", 1).alias("species_slug"), item(x).alias("item_slug")))
    return F.when((F.size(parts) >= 2) & model.isNotNull(), F.struct(model.alias("model_id"), named.alias("mons")))
