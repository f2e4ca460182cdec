"""The pipeline on the small tables and on awkward rows, against plain Python."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF
from lineupkit.runtime import stash
from test_text_ops import brute_classes


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def test_stages(steps):
    columns = steps["documents"].columns
    assert all(steps[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    before = {r.doc_id: r for r in steps["documents"].collect()}
    known = {r.doc_id: r for r in steps["language"].collect()}
    assert len(known) >= 0.98 * len(before) and all(before[k] == r for k, r in known.items())

    holders = {}
    for k, r in known.items():
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in r.text.split("\n")}:
            key = re.sub("[A-Z]", lambda m: m[0].lower(), line)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(k)
    want = {}
    for k, r in known.items():
        kept = []
        for line in r.text.split("\n"):
            own = holders.get(re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r")), set())
            if len(own) < 3 or max(own) == k:
                kept.append(line)
        text = "\n".join(kept)
        if text == r.text or text.strip():
            want[k] = text
    lined = {r.doc_id: r.text for r in steps["lines"].collect()}
    assert lined == want

    classes = brute_classes(list(lined.items()), 5, 80)
    kept = {r.doc_id for r in steps["near_copies"].collect()}
    assert kept == {k for k, (_, c) in classes.items() if c == k}

    mixed = Counter(r.doc_id for r in steps["mixture"].collect())
    assert set(mixed) <= kept and max(mixed.values()) <= 3
    pieces = steps["windows"].collect()
    assert {r.doc_id for r in pieces} == set(mixed)
    assert all(sum(r.length for r in pieces if r.doc_id == k) == n * next(r.doc_tokens for r in pieces if r.doc_id == k) for k, n in list(mixed.items())[:20])


def test_awkward_documents(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, draws int"
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, "x", 1), (None, "some words of text here", "en", None, 3, "", 2)]
    rows += [(k, "the quick brown fox jumps over it " * 3, "en", "a", 9, "", 0) for k in (4, 5, 5)] + [(9, "le chat noir et la souris grise " * 3, "fr", "b", 9, "", 0)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, SF), "test-awkward")
        assert docs.count() >= len(data) // 4


def test_near_copies_go_by_row(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = "one two three four five six seven eight nine ten", "some other words that stand in no copy at all here"
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, "z " * 9, "en", "t", 1), (3, "z " * 9, "en", "s", 1)]
    rows += [(None, a, None, "s", 1), (None, "alone " + b[::-1], None, "s", 1), (None, "alone " + b[::-1], None, "s", 1), (7, None, None, None, None), (7, None, None, None, None), (8, " ", None, None, None)]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, kinds).repartition(3), SF).collect()
    left = [rows[k] for k in (0, 2, 4, 6, 8, 9, 10)]
    assert sorted(map(tuple, got), key=str) == sorted(left, key=str)


def test_windows_hold_their_ids(spark):
    import zlib

    import numpy as np

    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for r in corpus_pipeline.windows(spark, docs, SF).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
