"""Operator 5: exact token counts of every prefix of a text for a byte-level BPE.

For one pre-token the number of tokens of every prefix obeys a recurrence: the encoding of a prefix
ends in exactly one token ``t`` such that the last token of what is before ``t`` and ``t`` stay apart
when encoded together, so ``count[i] = count[i - len(t)] + 1``.  The recurrence is run once for each
distinct stretch between a black and a blank and kept, as differences by character, in a bounded
table in each Python worker; a text's counts are the running sum of its stretches' differences.
Truncation and budget questions are then look-ups in that array: ``count_tokens`` stores it, compressed, beside each text's
id, and ``within_budget`` and ``tokens_of_prefix`` answer from the stored column without the text or the tokenizer.

Pre-tokens at a cut follow the tokenizer's pattern: a run of white space at the cut is one
pre-token, and inside a text its last blank joins the next word.

Nulls and edge cases: a null or empty text has the single count 0; strings of added tokens inside a
text count one token, cuts inside them count as plain text; null and repeated doc_ids are rows like
others; an empty table gives no rows; other columns pass through whatever their names.  Texts reach a worker in batches of a
few MB; one longer than that is held whole with eight bytes a character.  A worker's tables take some 250 MB at most.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineupkit.llm.bpe_words import default_path
from lineupkit.llm.workers import bound_batches, release
from lineupkit.runtime import stash, table

#: Stretches a worker keeps before it drops the later half (about 150 bytes each), and the longest it keeps.
MAX_UNITS, MAX_UNIT = 800_000, 64
#: Pairs of tokens and heads of pre-tokens a worker keeps (about 200 and 800 bytes each).
MAX_PAIRS, MAX_HEADS = 300_000, 50_000
#: Characters of a pre-token's head whose state is kept and shared by words that start alike.
HEAD = 6
#: Pre-tokens of the byte-level pattern, white space apart (fixed value).
_BLACK = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"\s+")
_SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]?)")
_AFTER_BLACK = regex.compile(r"(?<=\S) ")

_counters: dict[str, PrefixCounter] = {}


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Units(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> bytes:
        found = self.make(unit)
        if len(unit) <= MAX_UNIT:
            self[unit] = found
        return found


class PrefixCounter:
    """Prefix counts for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len)[::-1]
        letters = _byte_letters()
        own = set(letters.values())
        self.vocab = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if set(t) <= own}
        self.longest = max(map(len, self.vocab))
        self.table = {b: ord(c) for b, c in letters.items()}
        self.added_pattern = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.apart: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[list[int], list[str]]] = {}
        self.units = _Units(self._differences)

    def _stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) > MAX_PAIRS:
            self.apart.clear()
        got = self.model.tokenize(left + right)
        found = self.apart[left, right] = len(got) == 2 and got[0].value == left
        return found

    def pretoken(self, text: str) -> list[int]:
        """Tokens of every prefix (by character, from one on) of a single pre-token."""
        shown = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        n, vocab, longest, apart = len(shown), self.vocab, self.longest, self.apart
        known = self.heads.get(shown[:HEAD]) if n > HEAD else None
        if known:
            counts, last = known[0].copy(), known[1].copy()
        else:
            counts, last = [0], [""]
        for stop in range(len(counts), n + 1):
            for start in range(max(0, stop - longest), stop):
                token = shown[start:stop]
                if token in vocab:
                    if start:
                        fits = apart.get((last[start], token))
                        if not (self._stay_apart(last[start], token) if fits is None else fits):
                            continue
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            if stop == HEAD and n > HEAD:
                self.heads[shown[:HEAD]] = (counts.copy(), last.copy())
                if len(self.heads) > MAX_HEADS:
                    self.heads.clear()
        if n == len(text):
            return counts[1:]
        out, at = [], 0
        for c in text:
            at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            out.append(counts[at])
        return out

    def plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text that holds no added token's string."""
        out, base, at, lead = [], 0, 0, ""
        while at < len(text):
            space = _SPACE.match(text, at)
            if space:
                run = space.group()
                counts = self.pretoken(run)
                out += [base + c for c in counts]
                at = space.end()
                if at < len(text):
                    # The run splits: its last blank joins what follows, or stands alone.
                    base += counts[-2] if len(run) > 1 else 0
                    lead = run[-1] if run[-1] == " " else ""
                    if not lead:
                        base += self.pretoken(run[-1])[-1]
                continue
            black = _BLACK.match(text, at).group()
            if lead and len(black) > 1 and black[0] == "'" and black[1].isalpha():
                black = "'"  # after a blank the apostrophe is punctuation, not a contraction
                black = regex.match(r"[^\s\p{L}\p{N}]+", text, pos=at).group()
            counts = self.pretoken(lead + black)[len(lead) :]
            if not lead and len(black) == 3 and black[0] == "'" and black[1].isalpha():
                one = self.pretoken("'")[-1]
                counts = [one, one + self.pretoken(black[1])[-1], counts[-1]]
            out += [base + c for c in counts]
            base, at, lead = base + counts[-1], at + len(black), ""
        return np.array(out, np.int64)

    def _differences(self, unit: str) -> bytes:
        simple = _SIMPLE.fullmatch(unit)
        if simple:  # a word, perhaps with one mark after it
            counts = self.pretoken(simple[1])
            if simple[2]:
                counts.append(counts[-1] + 1)
        else:
            counts = self.plain(unit).tolist()
        return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def _special(self, text: str) -> np.ndarray:
        parts, at, base = [], 0, 0
        for found in self.added_pattern.finditer(text):
            counts = self.plain(text[at : found.end() - 1])
            parts.append(base + counts)
            base += (int(counts[found.start() - at - 1]) if found.start() > at else 0) + 1
            parts.append(np.array([base]))
            at = found.end()
        parts.append(base + self.plain(text[at:]))
        return np.concatenate(parts)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i = 0 .. len(text)."""
        if any(a in text for a in self.added):
            return np.concatenate([[0], self._special(text)])
        parts = text.split(" ")
        if " " in text and ("" in parts or any(p[-1:].isspace() for p in parts[:-1])):
            parts = _AFTER_BLACK.sub("\0 ", text).split("\0 ") if "\0" not in text else [text]
        look = self.units.__getitem__
        raw = [look(parts[0])] if parts[0] else []
        raw += [look(" " + p) for p in parts[1:]]
        if len(self.units) > MAX_UNITS:  # the stretches met first are the frequent ones
            kept = _Units(self._differences)
            kept.update(islice(self.units.items(), MAX_UNITS // 2))
            self.units = kept
        out = np.zeros(len(text) + 1, np.int64)
        np.cumsum(np.frombuffer(b"".join(raw), np.int16), out=out[1:])
        return out


def counter(path: str) -> PrefixCounter:
    """This worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def pack_prefixes(counts: np.ndarray) -> bytes:
    """The stored form of the counts of all prefixes."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(counts).astype("<i2").tobytes())


def open_prefixes(stored: bytes) -> np.ndarray:
    """Tokens of the first i characters, i from 0."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(stored), "<i2"), dtype=np.int64)])


def _from_stored(stored: DataFrame, places: Column, answers: list[str], ask) -> DataFrame:
    """``stored`` without its counts, and the columns ``answers``: ``ask(counts, place)`` for each row, null without either."""
    names = [f"c{i}_" for i in range(len(stored.columns))]
    held = names[stored.columns.index("prefix_tokens")]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, asked = batch.column(held).to_pylist(), batch.column("asked_").to_pylist()
            none = (None,) * len(answers)
            found = [none if r is None or x is None else ask(open_prefixes(r), x) for r, x in zip(raw, asked, strict=True)]
            more = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(answers))]
            kept = [n for n in names if n != held]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *more], names=[*kept, *(f"{a}_" for a in answers)])
        release()

    plain = stored.select("*", places.cast("long").alias("asked_")).toDF(*names, "asked_")
    schema = T.StructType([f for f in plain.schema.fields if f.name not in (held, "asked_")])
    for name in answers:
        schema = schema.add(f"{name}_", T.LongType())
    own = [F.col(n).alias(c) for c, n in zip(stored.columns, names, strict=True) if n != held]
    return plain.mapInArrow(answered, schema).select(*own, *[F.col(f"{a}_").alias(a) for a in answers])


def within_budget(stored: DataFrame, budget: int | Column) -> DataFrame:
    """``all_tokens`` and ``budget_chars`` (longest prefix of at most ``budget`` tokens) from stored counts."""
    place = budget if isinstance(budget, Column) else F.lit(budget)
    return _from_stored(stored, place, ["all_tokens", "budget_chars"], lambda counts, most: (int(counts[-1]), longest_prefix(counts, most)))


def tokens_of_prefix(stored: DataFrame, chars: int | Column) -> DataFrame:
    """``first_tokens``: tokens of the first ``chars`` characters (of all, if fewer) from stored counts."""
    place = chars if isinstance(chars, Column) else F.lit(chars)
    return _from_stored(stored, place, ["first_tokens"], lambda counts, k: (int(counts[min(max(k, 0), len(counts) - 1)]),))


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens (counts can fall as well as rise)."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def count_tokens(docs: DataFrame, budget: int | None = 512, vocabulary: str | None = None, store: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``fits_chars`` added.

    ``fits_chars`` is the length of the longest prefix within ``budget`` tokens (null without a budget).  With ``store`` the
    counts of all prefixes are added as ``prefix_tokens`` (their differences by character as zstd of little-endian int16),
    to answer later questions without encoding.
    """
    vocabulary = vocabulary or default_path("byte_bpe_50k.json")
    names = [f"c{i}_" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    kinds = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fits_chars", pa.int64())]
    kinds += [("prefix_tokens", pa.binary())] if store else []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple] = []
                for value in batch.column(text).to_pylist():
                    counts = own.prefixes(value or "")
                    n = int(counts[-1])
                    row = (len((value or "").encode()), n, None if budget is None else longest_prefix(counts, budget) if n > budget else len(counts) - 1)
                    rows.append((*row, pack_prefixes(counts)) if store else row)
                more = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, *(f"{n}_" for n, _ in kinds)])
        release()

    bound_batches(docs.sparkSession)
    plain = docs.toDF(*names)
    schema = T.StructType(list(plain.schema.fields))
    for name, kind in kinds:
        schema = schema.add(f"{name}_", T.LongType() if kind == pa.int64() else T.BinaryType())
    out = plain.mapInArrow(counted, schema)
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*own, *[F.col(f"{n}_").alias(n) for n, _ in kinds])


def op5_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix counts of all documents written once; their totals and what fits 512 tokens answered from the table."""
    made = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), None, store=True)
    stored = stash(made.select("doc_id", "n_bytes", "prefix_tokens"), "prefix-tokens")
    out = within_budget(stored, 512)
    return out.select(
        "doc_id", "n_bytes", F.col("all_tokens").alias("n_tokens"), (F.col("all_tokens") > 512).alias("over_limit"), F.col("budget_chars").alias("fits_chars")
    )
