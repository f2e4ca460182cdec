"""Operator 7: replace personal data by keyed surrogates, with DataFrame functions only.

Entities (mail addresses, telephone and payment card numbers, IP addresses, social security numbers,
IBANs, secrets after a key word, persons after a title) are found by one pattern.  A surrogate is a
function of (key, kind, normalised entity, attempt): the same entity gets the same surrogate in every
document.  Digits become digits and letters letters of the same case and script; punctuation stays;
cards keep a valid check digit and IBANs theirs; a mail domain maps by itself, so addresses of one
domain stay together; given names follow the entity's gender, all names the script and capitals.

Surrogates are made once for each distinct entity, in a table of their own, and joined to the mentions; so the plan over
the texts stays small.  First the parts that entities share (surnames, mail domains), then whole entities from them:
"Mr. John Smith" and "Dr. John Smith" are one entity whose gender is that of all its titles, and "Mrs. Smith" has their
surname.  Collision checks at both levels, over all documents: a surrogate that two entities share, or that is a real
entity somewhere, is drawn again (attempt + 1) for all but the first of them; later attempts have more letters, so that
they end.  Surnames and mail domains keep their surrogate whatever happens to the entities that they stand in.

Candidates that fail a check (Luhn, IBAN) are left as they are.  A mail address has at most 64
characters before the @.  A secret starts with at least 8 letters, digits or ``+/_=-`` and runs to its end, however
long: a blank, quote, bracket, comma, semicolon, ``&`` or ``?``, or the punctuation a sentence ends with.  A person
has every capitalised part, initial and particle (von, de la) that follows the title, with one blank between.

Nulls and edge cases: a null text stays null with 0 entities; null and repeated doc_ids are rows like
others; an empty table gives no rows; other columns pass through whatever their names.  Texts of any length are
searched whole; a text's mentions and its pieces are held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.runtime import drop_stash, stash, table

# Titles by gender.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
# Surrogate given names by gender and script.
GIVEN = {
    "male": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Lukas", "Marco", "Nils", "Oscar", "Paul"],
    "female": ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irma", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "neutral": ["Alex", "Ariel", "Charlie", "Dana", "Eden", "Jules", "Kim", "Lou", "Mika", "Noa", "Quinn", "Robin", "Sam", "Sasha", "Toni", "Yuki"],
    "male cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    "female cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
}
GIVEN["neutral cyrillic"] = ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Миша", "Вася", "Тоша", "Лёля", "Кира", "Ника", "Рома", "Тома", "Гена", "Лера"]
GIVEN["male greek"] = ["Ανδρέας", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"]
GIVEN["female greek"] = ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"]
GIVEN["neutral greek"] = ["Άγγελος", "Αύρα", "Ερμής", "Ήλιος", "Μελής", "Φοίβη", "Χάρις", "Ωρίων"]
# Syllables of surrogate surnames by script.
SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu", "va"]
CYRILLIC = ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"]
GREEK = ["βα", "γε", "δι", "ζο", "θυ", "κα", "λε", "μι", "νο", "ξυ", "πα", "ρε", "σι", "το", "φυ", "χα"]
# Particles inside names, which stay.
PARTICLES = ["von", "van", "de", "du", "di", "da", "del", "della", "dos", "bin", "ibn", "al", "der", "den", "dem", "la", "las", "los", "el", "zu"]
# Letters by script and case.
LETTERS = [
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"(?=\p{Ll})\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsGreek}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"(?=\p{Ll})\p{IsArmenian}", "աբգդեզէըթժիլխծկհձղճմ"),
    (r"\p{IsArmenian}", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄ"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsDevanagari}", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
    (r"\p{IsThai}", "กขคงจชซดตถทธนบปผพฟมยรลวสหอ"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHan}", "山川田中大小木林森水火土金石天地日月星光"),
    (r"\p{Lu}", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
    (r"\p{L}", "àáâäçèéêëìíîïñòóôöùúûü"),
]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(MALE + FEMALE + NEUTRAL)
_HEAD = rf"(?:{_TITLE})\.?(?: (?:{'|'.join(NEUTRAL)})\.?)*+ "
# Loops are possessive: Java takes them without recursion, so no length runs out of stack.
_NAME = r"(?:(?:\p{Lu}\.-?)*+\p{Lu}[\p{L}\p{M}'’-]++|\p{Lu}\.(?:-?\p{Lu}\.)*+|\p{Lu}(?![\p{L}\p{M}\p{N}]))"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES[:12])})(?: (?:{'|'.join(PARTICLES[12:])}))?+ )?+"
_SECRET = r"[A-Za-z0-9+/_=-]{8,}+(?:[.~!@#$%^*:|]++[A-Za-z0-9+/_=-]++)*+"
#: kind -> pattern, in order of precedence.
PATTERNS = {
    "secret": r"""(?<![\p{L}\p{N}])(?i:(?:api|access|secret|private)[_-]?key|(?:auth|access|bearer)[_-]?token|token|secret|passw(?:or)?d|pwd)["']? {0,2}[:=] {0,2}["']?""" + _SECRET,
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]|\.\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}+])\+(?!1[ (.-]?\(?\d{3})\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)|(?<![\p{N}.-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?<!\d[.,-])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_HEAD}{_PARTICLES}{_NAME}(?: {_PARTICLES}{_NAME})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text without any entity lacks: cheap to test, and no text with an entity fails it.
HINTS = ["[0-9@]", PATTERNS["secret"], PATTERNS["person"]]
DEFAULT_KEY = "lineupkit surrogate key"
_BITMAP_BITS = 24


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits, every second from the last doubled (its digits added)."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an IBAN (no blanks) with its first four characters moved to the end."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


def kind_of(entity: Column) -> Column:
    """The kind of a found candidate, or null if its check fails."""
    out = F.when(entity.rlike(f"^(?:{PATTERNS['secret']})$"), "secret")
    out = out.when(entity.contains("@"), "email")
    bare = F.replace(entity, F.lit(" "), F.lit(""))
    out = out.when(entity.rlike(f"^(?:{PATTERNS['iban']})$"), F.when(_mod97(bare) == 1, F.lit("iban")))
    for kind in ("phone", "ssn"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    out = out.when(entity.rlike(f"^(?:{PATTERNS['card']})$"), F.when(_luhn_sum(_digits(entity)) % 10 == 0, F.lit("card")))
    out = out.when(entity.rlike(f"^(?:{PATTERNS['ip']})$"), "ip")
    return out.when(entity.rlike(f"^(?:{PATTERNS['person']})$"), "person")


def _head(kind: Column, entity: Column) -> Column:
    """What stands before the part that identifies: a secret's key word, a person's title."""
    secret = F.regexp_extract(entity, rf"""^(.*?[:=] *["']?){_SECRET}$""", 1)
    person = F.regexp_extract(entity, f"^({_HEAD})", 1)
    return F.when(kind == "secret", secret).when(kind == "person", person).otherwise(F.lit(""))


def normal(kind: Column, tail: Column) -> Column:
    """The form that coreferent mentions share."""
    out = F.when(kind == "phone", F.concat(F.when(tail.startswith("+"), "+").otherwise(""), _digits(tail)))
    out = out.when(kind.isin("card", "ssn"), _digits(tail))
    out = out.when(kind == "iban", F.replace(tail, F.lit(" "), F.lit("")))
    return out.when(kind.isin("email", "person"), F.lower(tail)).otherwise(tail)


def _random(*parts: Column) -> Column:
    """64 bytes as hex, from a keyed hash."""
    first = F.sha2(F.concat_ws("\x01", *parts), 256)
    return F.concat(first, F.sha2(F.concat(first, *parts), 256))


def _byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _scramble(s: Column, hexes: Column) -> Column:
    """Every digit and letter replaced within its class; all else stays."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(hexes, i)
        out = F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
        for pattern, letters in LETTERS:
            out = out.when(c.rlike(pattern), F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def _hex_scramble(s: Column, hexes: Column) -> Column:
    return F.substring(F.repeat(hexes, F.ceil(F.length(s) / 128).cast("int")), F.lit(1), F.length(s))


def _script(word: Column) -> Column:
    out = F.when(word.rlike("[а-яёА-ЯЁ]"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
    return out.when(word.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def _parts_made(parts: DataFrame, key: str) -> DataFrame:
    """``other``: the surrogate of a shared part (kind surname or domain, norm in lower case)."""
    norm, attempt = F.col("norm"), F.col("attempt")
    parts = parts.withColumn("hexes_", _random(F.lit(key), F.col("kind"), norm, attempt.cast("string")))
    hexes, count = F.col("hexes_"), F.least(F.lit(40), attempt + 3)

    def syllables(table: list[str]) -> Column:
        of = F.array(*map(F.lit, table))
        return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(of, _byte(hexes, i) % 16 + 1)), "")

    more = F.repeat(F.substring(norm, 1, 1), F.greatest(F.lit(0), attempt - 2))
    script = _script(norm)
    name = F.when(script == "latin", syllables(SYLLABLES)).when(script == "cyrillic", syllables(CYRILLIC)).when(script == "greek", syllables(GREEK))
    name = name.otherwise(_scramble(F.concat(norm, more), hexes))
    name = F.when(norm.endswith(".") & (script != "other"), F.concat(name, F.lit("."))).otherwise(name)
    top = F.substring_index(norm, ".", -1)
    host = F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1)
    domain = F.concat(_scramble(F.concat(host, more), hexes), F.lit("."), top)
    return parts.withColumn("other", F.when(F.col("kind") == "surname", name).otherwise(domain)).drop("hexes_")


def _given(part: Column, gender: Column, norm: Column, attempt: Column, key: str) -> Column:
    """A part before the surname, in lower case: particles stay, initials become initials, names follow gender and script."""
    seed = F.concat_ws("\x01", part, gender, F.when(attempt > 0, norm).otherwise(F.lit("")), attempt.cast("string"))
    own = _random(F.lit(key), F.lit("given"), seed)
    what = F.concat_ws(" ", gender, F.when(_script(part) != "latin", _script(part)))
    names = F.create_map(*[x for k, v in GIVEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def made(hexes: Column) -> Column:
        table = names[what]
        drawn = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(table, _byte(hexes, i) % F.size(table) + 1))
        more = F.repeat(F.substring(part, 1, 1), F.greatest(F.lit(0), attempt - 2))
        initial = part.contains(".") | (F.length(part) == 1) | table.isNull()
        return F.when(initial, _scramble(F.concat(part, more), hexes)).otherwise(F.lower(F.array_join(drawn, "-")))

    return F.when(part.isin(PARTICLES), part).otherwise(_let(own, made))


def _entities_made(found: DataFrame, key: str) -> DataFrame:
    """``other``: an entity's surrogate in its normal form, from ``part_other``, the surrogate of its surname or domain."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    found = found.withColumn("hexes_", _random(F.lit(key), kind, norm, attempt.cast("string")))
    hexes = F.col("hexes_")
    more = F.repeat(F.lit("a"), F.greatest(F.lit(0), attempt - 2))
    held = F.when(kind == "email", F.concat(F.substring_index(norm, "@", 1), more)).when(kind == "secret", F.concat(norm, more)).otherwise(norm)
    mixed = F.when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), _hex_scramble(norm, hexes)).otherwise(_scramble(held, hexes))
    found = found.withColumn("mixed_", F.when(~kind.isin("person", "ip"), mixed))
    mixed = F.col("mixed_")
    body = F.substring(mixed, F.lit(1), F.length(mixed) - 1)
    luhn = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    rest = F.substring(mixed, F.lit(5), F.length(mixed))
    checked = F.lpad((98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), rest))).cast("string"), 2, "0")
    country = F.regexp_extract(norm, r"^\+(?:1|7|\d\d)", 0)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(hexes, i) % 254 + 1).cast("string")), ".")
    parts = F.split(norm, " ")
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: _given(p, F.col("gender"), norm, attempt, key))
    out = (
        F.when(kind == "email", F.concat(mixed, F.lit("@"), F.col("part_other")))
        .when(kind == "card", luhn)
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), checked, rest))
        .when(kind == "phone", F.concat(country, F.substring(mixed, F.length(country) + 1, F.length(mixed))))
        .when(kind == "ip", ip)
        .when(kind == "person", F.array_join(F.concat(before, F.array("part_other")), " "))
        .otherwise(mixed)
    )
    return found.withColumn("other", out).drop("hexes_", "mixed_")


def _settle(found: DataFrame, make, key: str, rounds: int) -> DataFrame:
    """``found`` (kind, norm, ...) with ``other``: a surrogate for each, none shared and none real (written)."""
    now = found.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        made = stash(make(now, key), "pii-surrogates")
        # The first of equal surrogates keeps it; none may be a real entity.
        first = made.groupBy("kind", "other").agg(F.min("norm").alias("first_"))
        real = made.select("kind", F.col("norm").alias("other"), F.lit(True).alias("real_")).distinct()
        clash = (F.col("norm") != F.col("first_")) | F.col("real_").isNotNull()
        now = made.join(first, ["kind", "other"]).join(real, ["kind", "other"], "left").withColumn("clash_", clash)
        now = stash(now.drop("first_", "real_"), "pii-attempts")
        drop_stash(made)
        if now.where("clash_").isEmpty():
            return now.drop("clash_", "attempt")
        now = now.withColumn("attempt", F.col("attempt") + F.col("clash_").cast("int")).drop("clash_", "other")
    raise RuntimeError(f"surrogates did not settle in {rounds} rounds: too few of one format")


def _written(kind: Column, head: Column, tail: Column, other: Column) -> Column:
    """A surrogate in the format of one mention: its punctuation, blanks and capitals."""
    bare = F.regexp_replace(other, r"[^\p{L}\p{N}]", "")

    def pour(done: Column, c: Column) -> Column:
        taken = F.substring(bare, done["k"], F.lit(1))
        cased = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(taken)).otherwise(taken)
        fills = c.rlike(r"[\p{L}\p{N}]")
        return F.struct((done["k"] + fills.cast("int")).alias("k"), F.concat(done["s"], F.when(fills, cased).otherwise(c)).alias("s"))

    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("s"))
    poured = F.aggregate(F.filter(F.split(tail, ""), lambda c: c != ""), start, pour, lambda d: d["s"])
    # Later attempts can be longer than the mention.
    poured = F.when(F.length(_bare(tail)) == F.length(bare), poured).otherwise(other)

    def styled(part: Column, new: Column) -> Column:
        loud = (part == F.upper(part)) & (F.length(_bare(part)) > 1)
        pieces = F.array_join(F.transform(F.split(new, "-"), lambda p: F.initcap(p)), "-")
        return F.when(part == F.lower(part), new).when(loud, F.upper(new)).otherwise(pieces)

    name = F.array_join(F.zip_with(F.split(tail, " "), F.split(other, " "), styled), " ")
    return F.concat(head, F.when(kind == "person", name).when(kind.isin("ip", "secret"), other).otherwise(poured))


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def surrogates(mentions: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, entity, new) for the distinct (kind, entity) of ``mentions`` (written)."""
    forms = mentions.select("kind", "entity").distinct()
    forms = forms.withColumn("head", _head(F.col("kind"), F.col("entity")))
    forms = forms.withColumn("tail", F.substring(F.col("entity"), F.length("head") + 1, F.length("entity")))
    forms = stash(forms.withColumn("norm", normal(F.col("kind"), F.col("tail"))), "pii-forms")
    title = F.regexp_extract("head", "^[^. ]+", 0)
    known = forms.groupBy("kind", "norm").agg(F.max(title.isin(MALE)).alias("male"), F.max(title.isin(FEMALE)).alias("female"))
    gender = F.when(F.col("male") & ~F.col("female"), "male").when(F.col("female") & ~F.col("male"), "female").otherwise("neutral")
    part = F.when(F.col("kind") == "person", F.element_at(F.split("norm", " "), -1)).when(F.col("kind") == "email", F.substring_index("norm", "@", -1))
    of = F.when(F.col("kind") == "person", "surname").when(F.col("kind") == "email", "domain")
    known = stash(known.select("kind", "norm", gender.alias("gender"), of.alias("part_kind"), part.alias("part")), "pii-entities")
    parts = known.where("part_kind IS NOT NULL").select(F.col("part_kind").alias("kind"), F.col("part").alias("norm")).distinct()
    parts = _settle(parts, _parts_made, key, rounds).select(F.col("kind").alias("part_kind"), F.col("norm").alias("part"), F.col("other").alias("part_other"))
    whole = known.join(parts, ["part_kind", "part"], "left").select("kind", "norm", "gender", "part_other")
    whole = _settle(whole, _entities_made, key, rounds)
    new = _written(F.col("kind"), F.col("head"), F.col("tail"), F.col("other"))
    out = stash(forms.join(whole.select("kind", "norm", "other"), ["kind", "norm"]).select("kind", "entity", new.alias("new")), "pii-new")
    for df in (forms, known, parts, whole):
        drop_stash(df)
    return out


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced; ``n_entities`` and ``kinds`` (sorted) added."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    text, same = F.col(at["text"]), [at["doc_id"], at["text"]]
    plain = docs.toDF(*names).withColumns({"a_": F.xxhash64(*same), "b_": F.xxhash64(F.lit("second"), *same)})
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    maybe = text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    mentions = plain.where(maybe).select("a_", "b_", F.posexplode(found).alias("pos", "entity"))
    mentions = stash(mentions.withColumn("kind", kind_of(F.col("entity"))).where("kind IS NOT NULL").distinct(), "pii-mentions")
    new = mentions.join(surrogates(mentions, key), ["kind", "entity"])
    # One row a document: rows alike in doc_id and text share it.
    per_row = new.groupBy("a_", "b_").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("new_"), F.count("*").alias("n_"), F.sort_array(F.collect_set("kind")).alias("kinds_")
    )
    per_row = stash(per_row, "pii-rows")
    drop_stash(mentions)
    # Only documents with an entity meet its surrogates: a bitmap of fixed size (2**18 words at most, a proven bound for the
    # broadcast) tells them, and a few others, from the rest, whose texts are not moved.
    spot = F.pmod("a_", F.lit(1 << _BITMAP_BITS))
    word, bit = F.shiftright(spot, 6), F.expr(f"shiftleft(1L, cast(pmod(a_, {1 << _BITMAP_BITS}) % 64 as int))")
    bitmap = per_row.groupBy(word.alias("word_")).agg(F.bit_or(bit).alias("bits_"))
    marked = plain.join(F.broadcast(bitmap), word == F.col("word_"), "left")
    hit = F.coalesce(F.col("bits_").bitwiseAND(bit) != 0, F.lit(False))
    found_rows = marked.where(hit).drop("word_", "bits_").join(per_row, ["a_", "b_"], "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in per_row.schema.fields if f.name not in ("a_", "b_")]
    rows = found_rows.unionByName(marked.where(~hit).drop("word_", "bits_").select("*", *nothing))
    pieces = F.transform(found, lambda e, i: F.coalesce(F.try_element_at("new_", i), e))
    gaps = F.split(text, ANY, -1)
    woven = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), pieces.alias("n")), lambda p: F.concat(p["g"], F.coalesce(p["n"], F.lit("")))), "")
    rows = rows.withColumn("text_", F.when(F.col("n_").isNotNull(), woven).otherwise(text))
    own = [F.col("text_" if c == "text" else n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return rows.select(
        *own, F.coalesce("n_", F.lit(0)).cast("long").alias("n_entities"), F.coalesce("kinds_", F.array().cast("array<string>")).alias("kinds")
    )


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
