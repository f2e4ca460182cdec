"""Canonical names of species and items, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracketed formes that say nothing, and regional prefixes.
COSMETIC = [
    "family of four", "family of three", "unremarkable form", "masterpiece form", "phony form", "antique form",
    "green plumage", "blue plumage", "yellow plumage", "white plumage", "small size", "average size", "large size", "super size",
]
REGIONS = ["hisuian", "alolan", "galarian", "paldean"]
# Fixed values of species slugs: whole names, regions, formes that stand before or after their species, bases with hyphens of their own.
SLUGS = {
    "eternal flower floette": "floette", "paldean tauros aqua breed": "tauros-paldeaaqua",
    "paldean tauros blaze breed": "tauros-paldeablaze", "paldean tauros combat breed": "tauros-paldeacombat",
}
SLUG_REGIONS = {"alolan": "alola", "galarian": "galar", "hisuian": "hisui", "paldean": "paldea"}
ROTOM_FORMES = ["wash", "heat", "frost", "mow", "fan"]
LYCANROC_FORMES = ["dusk", "midnight", "midday"]
HYPHENED = ["ho-oh", "porygon-z", "jangmo-o", "hakamo-o", "kommo-o", "wo-chien", "chien-pao", "ting-lu", "chi-yu", "type-null", "nidoran-f", "nidoran-m"]
# Aliases, spellings of no item, and items that a regulation forbids.
SPECIES_ALIASES = {"Floette": "Eternal Flower Floette"}
ITEM_ALIASES = {"Dread Plate": "Black Glasses", "Glimmorite": "Glimmoranite", "King’s Rock": "King's Rock"}
ITEMLESS = ["None", "No Item", "Nothing", "Null"]
ILLEGAL_ITEMS = {
    "M-A": ["Covert Cloak", "Assault Vest", "Safety Goggles"],
    "M-B": ["Covert Cloak", "Assault Vest", "Safety Goggles"],
}


def strip_blanks(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` planned and computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Trimmed, lower-cased, every word and every hyphen part capitalised; blank gives null."""
    part = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))
    word = lambda w: F.array_join(F.transform(F.split(w, "-", -1), part), "-")
    whole = lambda bare: F.when(bare != "", F.array_join(F.transform(F.split(bare, r"(?U)\s+"), word), " "))
    return let(strip_blanks(F.lower(name)), whole)


def bracket_forme(name: Column) -> Column:
    """``Base [Forme]`` as a prefix or suffix of the base; names of another shape stay."""
    shape = r"^(.+?)\s*\[(.+)\]\s*$"

    def regional(base: Column, held: Column, region: str) -> Column:
        def joined(rest: Column) -> Column:
            breed = F.when(rest.startswith("- "), F.concat(F.lit(" "), strip_blanks(F.substring(rest, F.lit(3), F.length(rest))))).otherwise("")
            return F.concat(F.lit(f"{region.capitalize()} "), base, breed)

        return let(strip_blanks(F.substring(held, F.lit(len(region) + 6), F.length(held))), joined)

    def renamed(parts: Column) -> Column:
        whole, base, held, low = (parts[k] for k in ("name", "base", "held", "low"))
        out = F.when(low.isin([*COSMETIC, "male"]), base).when(low == "female", F.concat(base, F.lit(" ♀")))
        out = out.when((F.lower(base) == "rotom") & low.contains("rotom"), held)
        for region in REGIONS:
            out = out.when(low.startswith(f"{region} form"), regional(base, held, region))
        out = out.when(low == "eternal flower", F.concat(F.lit("Eternal Flower "), base))
        word = strip_blanks(F.substring(held, F.lit(1), F.length(held) - 5))
        return out.when(low.endswith(" form"), F.concat(base, F.lit(" "), word)).otherwise(whole)

    def split(name: Column) -> Column:
        base, held = (strip_blanks(F.regexp_extract(name, shape, k)) for k in (1, 2))
        parts = let(held, lambda h: F.struct(name.alias("name"), base.alias("base"), h.alias("held"), F.lower(h).alias("low")))
        return F.when(~name.rlike(shape), name).otherwise(let(parts, renamed))

    return let(name, split)


def strip_mega(species: Column) -> Column:
    """``Mega Base`` and ``Mega Base X`` (Y, Z) as ``Base``."""
    bare = lambda s: F.when(s.startswith("Mega "), F.regexp_replace(F.substring(s, F.lit(6), F.length(s)), " [XYZ]$", "")).otherwise(s)
    return let(species, bare)


def _alias(name: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return let(name, lambda n: F.coalesce(F.try_element_at(table, n), n))


def species_name(raw: Column) -> Column:
    """Bracket rule, canonical form, mega prefix, alias, in this order; null for a blank name."""
    return _alias(strip_mega(normalize_name(bracket_forme(raw))), SPECIES_ALIASES)


def item_name(raw: Column, regulation: Column) -> Column:
    """Canonical form; null where nothing is held or the regulation forbids the item."""
    banned = F.create_map(*[x for k, v in ILLEGAL_ITEMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def allowed(named: Column) -> Column:
        forbidden = F.coalesce(F.array_contains(F.try_element_at(banned, F.coalesce(regulation, F.lit(""))), named), F.lit(False))
        return F.when(~forbidden, named)

    held = let(normalize_name(raw), lambda n: F.when(~n.isin(ITEMLESS), n))
    return let(_alias(held, ITEM_ALIASES), allowed)


def format_pair(species: Column, item: Column) -> Column:
    """``Species @ Item``, a missing item written as None."""
    return F.concat(species, F.lit(" @ "), F.coalesce(item, F.lit("None")))


def pair_parts(feature: Column) -> tuple[Column, Column]:
    """Species and item (null for None or without one) of a ``Species @ Item`` feature."""
    item = F.when(feature.contains(" @ "), F.regexp_extract(feature, r"^.*? @ (.*)$", 1))
    return F.substring_index(feature, " @ ", 1), F.when(item != "None", item)


def slugify(name: Column) -> Column:
    """Lower-case words joined by hyphens, all else dropped; null where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return let(out, lambda x: F.when(x != "", x))


def species_slug(name: Column) -> Column:
    """Slug of a species: regions and formes behind the base, words joined, at most the first hyphen kept."""
    regions = F.create_map(*[F.lit(x) for pair in SLUG_REGIONS.items() for x in pair])
    whole = F.create_map(*[F.lit(x) for pair in SLUGS.items() for x in pair])

    def hyphened(joined: Column) -> Column:
        cut = F.instr(joined, "-")
        tail = F.regexp_replace(F.substring(joined, cut + F.lit(1), F.length(joined)), "-", "")
        plain = F.when(joined.isin(HYPHENED), F.regexp_replace(joined, "-", ""))
        return plain.when(cut > 0, F.concat(F.substring(joined, F.lit(1), cut), tail)).otherwise(joined)

    def of_words(words: Column) -> Column:
        one, two, count = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.size(words)
        region = F.try_element_at(regions, one)
        out = F.when((count >= 2) & region.isNotNull(), F.concat(F.array_join(F.slice(words, F.lit(2), count), ""), F.lit("-"), region))
        out = out.when((count == 2) & (two == "rotom") & one.isin(ROTOM_FORMES), F.concat(F.lit("rotom-"), one))
        forme = F.when(two == "midday", "lycanroc").otherwise(F.concat(F.lit("lycanroc-"), two))
        out = out.when((count == 2) & (one == "lycanroc") & two.isin(LYCANROC_FORMES), forme)
        return out.otherwise(let(F.array_join(words, ""), hyphened))

    def of_low(low: Column) -> Column:
        bare = F.regexp_replace(low, r"(?U)[^a-z0-9\s-]+", "")
        words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
        return F.coalesce(F.try_element_at(whole, low), let(words, of_words))

    return let(F.lower(name), of_low)
