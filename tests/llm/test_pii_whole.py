"""Surrogates cover whole entities: nothing of a long secret or of a name stays."""

import re

import pytest
from lineupkit.llm import pii

LONG = "".join(f"{k:04x}Zq" for k in range(900))[:5000]
HEX = "".join(f"{k * 7919 % 65536:04x}" for k in range(1250))
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"
DOTS = "abcdefgh" + ".x1" * 4000
#: text, what must be gone, what the result must match as a whole.
CASES = [
    (f"token={LONG} end", [LONG[k : k + 12] for k in range(0, 4988, 12)], r"token=[0-9A-Za-z]{5000} end"),
    (f"api_key: '{HEX}', end", [HEX[k : k + 12] for k in range(0, 4988, 12)], r"api_key: '[0-9a-f]{5000}', end"),
    (f"access_token = {JWT}. Next", JWT.split("."), r"access_token = \w{20}\.\w{27}\.\w{42}\. Next"),
    (f"secret={DOTS}", ["abcdefgh"], r"secret=\w{8}(?:\.[a-z]\d){4000}"),
    ("pwd: hunter22$Tail!rest, end", ["Tail", "rest"], r"pwd: \w{8}\$\w{4}!\w{4}, end"),
    ("Dr. Anna Maria Schmidt came", ["Anna", "Maria", "Schmidt"], r"Dr\. \w+ \w+ \w+ came"),
    ("Mr. J. Smith came", ["J. ", "Smith"], r"Mr\. [A-Z]\. \w+ came"),
    ("Mr. J.R.R. Tolkien, Mr. J Smith.", ["Tolkien", "Smith"], r"Mr\. [A-Z]\.[A-Z]\.[A-Z]\. \w+, Mr\. [A-Z] \w+\."),
    ("Herr Prof. Dr. Karl Ludwig von der Heide ging", ["Karl", "Ludwig", "Heide"], r"Herr Prof\. Dr\. \w+ \w+ von der \w+ ging"),
    ("Mrs. Jose\u0301 O'Neil-Lang and Mr. John S. there", ["Jose", "\u0301", "Neil", "Lang", "John", " S."], r"Mrs\. \w+ \w+ and Mr\. \w+ \w{3,}\. there"),
    ("г-жа Иванова Зинаида Петровна пришла", ["Иванова", "Зинаида", "Петровна"], r"г-жа \w+ \w+ \w+ пришла"),
    ("Mr. " + "A." * 5000 + " Zed" + "x" * 100 + " Last", ["Zedx", "xxx", "Last"], r"Mr\. (?:[A-Z]\.){5000} \w+ \w+"),
]


@pytest.fixture(scope="module")
def replaced(spark):
    docs = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace_entities(docs).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_nothing_left_over(replaced, k):
    _, gone, shape = CASES[k]
    got = replaced[k]
    assert got.n_entities >= 1 and [g for g in gone if g in got.text] == []
    assert re.fullmatch(shape, got.text)


def test_one_person_in_many_forms(spark):
    """Coreference: one given name and one surname for a person, whatever the title, capitals or document."""
    texts = ["Mr. John Smith and Dr. John Smith", "Dr. JOHN SMITH met Mrs. Smith, Mrs. Mary Smith and Mr. Mark Smith", "Dr. Γιώργος Παππάς, Mr. Παππάς", "Mr. Արամ Պետրոսյան"]
    texts += ["call 476-555-6291 or (476) 555-6291", "a.b@mail.example.org A.B@Mail.Example.org c@mail.example.org x@other.example.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.replace_entities(docs).orderBy("doc_id").collect()]
    first = re.fullmatch(r"Mr\. (\w+) (\w+) and Dr\. (\w+) (\w+)", got[0]).groups()
    assert first[:2] == first[2:] and first[0] in pii.GIVEN["male"]
    second = re.fullmatch(r"Dr\. (\w+) (\w+) met Mrs\. (\w+), Mrs\. ([\w-]+) (\w+) and Mr\. ([\w-]+) (\w+)", got[1]).groups()
    assert second[:2] == (first[0].upper(), first[1].upper()) and {second[2], second[4], second[6]} == {first[1]}
    assert second[5] != first[0] and second[3].split("-")[0] in pii.GIVEN["female"]
    greek = re.fullmatch(r"Dr\. ([Ά-ώ]+) ([Ά-ώ]+), Mr\. ([Ά-ώ]+)", got[2]).groups()
    assert greek[1] == greek[2] and "Παππάς" not in got[2] and "Γιώργος" not in got[2]
    assert re.fullmatch(r"Mr\. [Ա-և]+ [Ա-և]+", got[3]) and "Արամ" not in got[3]
    phones = re.fullmatch(r"call (\d{3}-\d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", got[4]).groups()
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1
    mails = got[5].split(" ")
    assert mails[0] == mails[1].lower() and mails[0].split("@")[1] == mails[2].split("@")[1] != mails[3].split("@")[1]


def test_domains_and_surnames_stay_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "LETTERS", [("[a-z]", "ab")])
    texts = [f"{x}@{y}.com" for x in "abc" for y in ("a", "b", "c", "d", "e")] + [f"Mr. {x} Same" for x in ("Al", "Bo", "Cy", "Di") for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(docs).collect()}
    new = dict(zip(texts, [got[k] for k in range(len(texts))], strict=True))
    assert len(set(new.values())) == len(set(texts)) and not set(new.values()) & set(texts)
    domains = {t.split("@")[1]: n.split("@")[1] for t, n in new.items() if "@" in t}
    assert len(set(domains.values())) == 5 and not set(domains.values()) & set(domains)


PLAIN = {  # a plain detector, for the kinds that stand in the documents
    "email": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "secret": r'(?<=token = ")[0-9a-f]{40}(?=")',
    "card": r"(?<![\d.,-])\d{16}(?!\d)",
}


def test_all_documents_against_a_plain_detector(spark):
    """Every entity gone, one surrogate for each and the same in all documents, shapes kept, clean texts untouched."""

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    new: dict = {}
    for r in pii.replace_entities(docs).collect():
        old, total = before[r.doc_id], 0
        for kind, pattern in PLAIN.items():
            a, b = re.findall(pattern, old or ""), re.findall(pattern, r.text or "")
            if kind == "card":
                a, b = [x for x in a if luhn(x)], [x for x in b if luhn(x)]
            assert len(a) == len(b), (r.doc_id, kind, a, b)
            total += len(a)
            for x, y in zip(a, b, strict=True):
                assert new.setdefault((kind, x.lower()), y.lower()) == y.lower() != x.lower()
                if kind in ("phone", "email"):
                    assert re.sub("[a-z]", "a", re.sub(r"\d", "9", x)).split(".")[:-1] == re.sub("[a-z]", "a", re.sub(r"\d", "9", y)).split(".")[:-1]
        if r.n_entities == 0:
            assert r.text == old
        assert r.n_entities >= total
    assert len(new) > 50 and len({(k, y) for (k, _), y in new.items()}) == len(new)
