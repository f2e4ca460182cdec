"""Operator 4: language identification by a convolutional network over bytes.

Filters of several widths slide over the bytes of fixed-length windows, each filter's largest
response in a window is kept, and a softmax layer reads them.  The network is trained in numpy on a
bounded sample of labelled windows (those of the ``per_language`` distinct texts of each language with the smallest
hashes of all labelled documents, window places by hash as well).  A prediction covers the whole text: every
window counts, and the windows' log-probabilities are averaged, weighted by their bytes.

Filters read bytes through tables: the contributions of two neighbouring bytes to all filters are
one row of a 65,536-row table, so a window costs a few gathers and one maximum.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0; labels that are
null are not learned from; with no labelled row every text is ``und``; an empty table gives no rows;
null and repeated doc_ids are rows like others; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineupkit.llm.workers import bound_batches, release
from lineupkit.runtime import local_table, table

WINDOW, FILTERS, WIDTHS = 256, 12, (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """Weights: one (width, 256, filters) array a width, then (features, languages) and a bias."""

    languages: list[str]
    filters: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Contributions of byte pairs, side by side for width 2, 3, 4 (first, second pair); of the third byte."""
        two, three, four = self.filters
        pair = lambda w, a, b: (w[a][:, None] + w[b][None]).reshape(65_536, -1)
        pairs = np.concatenate([pair(two, 0, 1), pair(three, 0, 1), pair(four, 0, 1), pair(four, 2, 3)], 1)
        return np.ascontiguousarray(pairs, np.float32), np.ascontiguousarray(three[2], np.float32)

    def features(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray], chunk: int = 64) -> np.ndarray:
        """(windows, WINDOW + 3) bytes to (windows, features): the largest response of each filter."""
        pairs, third = tables
        n = self.filters[0].shape[2]
        out = np.empty((len(windows), 3 * n), np.float32)
        for at in range(0, len(windows), chunk):
            w = windows[at : at + chunk]
            both = pairs[w[:, :-1].astype(np.int32) << 8 | w[:, 1:]]
            rows = slice(at, at + len(w))
            out[rows, :n] = both[:, :WINDOW, :n].max(1)
            out[rows, n : 2 * n] = (both[:, :WINDOW, n : 2 * n] + third[w[:, 2 : WINDOW + 2]]).max(1)
            out[rows, 2 * n :] = (both[:, :WINDOW, 2 * n : 3 * n] + both[:, 2 : WINDOW + 2, 3 * n :]).max(1)
        return np.maximum(out, 0)

    def log_probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut_windows(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts laid end to end: bytes (padded by 0), the text of each, its number of bytes.

    Every byte of a text is in one window; filters that start in a window see three bytes past it.
    """
    count = np.maximum(1, -(-(stops - starts) // WINDOW))
    text = np.repeat(np.arange(len(starts)), count)
    first = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    place = first[:, None] + np.arange(WINDOW + 3)
    inside = place < stops[text][:, None]
    windows = np.where(inside, data[np.minimum(place, len(data) - 1)] if len(data) else 0, 0).astype(np.uint8)
    return windows, text, np.minimum(WINDOW, stops[text] - first)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 7) -> ByteConvNet:
    """Fit by Adam on mini-batches; the gradient of a maximum flows to the place that has it."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = 0  # padding is silent
    out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    net = ByteConvNet(languages, filters, out, np.zeros(len(languages), np.float32))
    params = [*filters, net.out, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, batch = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            w, y = windows[pick], labels[pick]
            best, high = [], []
            for f in filters:
                z = sum(f[j][w[:, j : j + WINDOW]] for j in range(f.shape[0]))
                where = z.argmax(1)
                best.append(where)
                high.append(np.take_along_axis(z, where[:, None], 1)[:, 0])
            x = np.concatenate(high, 1)
            h = np.maximum(x, 0)
            p = np.exp(net.log_probabilities(h))
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            dx = (p @ net.out.T) * (x > 0)
            grads = []
            for k, f in enumerate(filters):
                g = np.zeros_like(f)
                d = dx[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(f.shape[0]):
                    seen = np.take_along_axis(w, best[k] + j, 1)
                    np.add.at(g[j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), d)
                g[:, 0] = 0
                grads.append(g)
            grads += [h.T @ p, p.sum(0)]
            step += 1
            rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, per_language: int = 1_500, seed: int = 11, max_languages: int = 10_000) -> ByteConvNet | None:
    """Train on a bounded sample of (text, lang) rows: ``per_language`` distinct texts of each language.

    Copies of a text count once, so a group of copies can't fill a language's sample.  Those drawn are the
    texts with the smallest hashes: a share computed from the full counts leaves a few more than are asked for, and
    these alone are put in order.  Then one window a text, at a place that a hash picks from its whole length.
    More than ``max_languages`` labels are an error (the driver holds the sample).
    """
    spark = labelled.sparkSession
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select("text", "lang")
    hashed = rows.select("lang", F.xxhash64(F.lit(seed), "text").alias("hash_"))
    counts = {r.lang: r.n for r in hashed.distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    span, most = 1 << 40, per_language + 6 * int(per_language**0.5) + 20
    wanted = [(k, min(span, -(-span * most // n)), -(-per_language // n)) for k, n in counts.items()]
    shares = local_table(spark, wanted, "lang string, share_ long, windows_ long")
    near = F.pmod("hash_", F.lit(span)) < F.col("share_")
    few = hashed.join(F.broadcast(shares), "lang").where(near).select("lang", "hash_", "windows_").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod("hash_", F.lit(span)), "hash_")
    few = few.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= per_language)
    # At most per_language short rows a language: a proven bound for the broadcast.
    texts = rows.withColumn("hash_", F.xxhash64(F.lit(seed), "text")).join(F.broadcast(few), ["lang", "hash_"])
    drawn = texts.groupBy("lang", "hash_").agg(F.min("text").alias("text"), F.first("windows_").alias("windows_"))
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "text", "n_"), F.greatest(F.lit(1), F.length("text") - WINDOW // 2))
    # A language of few documents gives several windows of each, at most 16.
    many = drawn.select("lang", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(16), F.col("windows_")))).alias("n_"))
    cut = many.select("lang", F.encode(F.substring("text", (at + 1).cast("int"), F.lit(WINDOW)), "utf-8").alias("cut_"))
    sample = cut.collect()  # two windows for each text asked for, at most
    sample.sort(key=lambda r: (r.lang, bytes(r.cut_)))
    languages = sorted(counts)
    # Every eighth window is shown in capitals as well: headings and shouted text are rare but real.
    sample += [(r.lang, r.cut_.decode("utf-8").upper().encode()) for r in sample[::8]]
    parts = [bytes(cut)[:WINDOW] for _, cut in sample]
    data = np.frombuffer(b"".join(parts), np.uint8)
    stops = np.cumsum([len(p) for p in parts])
    windows, text, _ = cut_windows(data, stops - [len(p) for p in parts], stops)
    labels = np.array([languages.index(lang) for lang, _ in sample])[text]
    return train(windows, labels, languages)


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, from ``text`` alone."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("letters_", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    n_langs = len(net.languages) if net else 0

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                n = batch.num_rows
                known = np.array(batch.column("letters_").to_pylist(), bool) & bool(n_langs)
                total = np.zeros((n, max(1, n_langs)))
                rows = np.flatnonzero(known)
                if len(rows):
                    texts = batch.column(text).take(pa.array(rows)).cast(pa.large_string())
                    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(rows) + 1, texts.offset * 8)
                    data = np.frombuffer(texts.buffers()[2], np.uint8)
                    # Pieces of texts of at most a few MB at a time, however long one text is.
                    for lo, hi in _pieces(offsets, 4 << 20):
                        starts = np.maximum(offsets[:-1], lo)
                        stops = np.minimum(offsets[1:], hi)
                        own = np.flatnonzero(stops > starts)
                        windows, which, weight = cut_windows(data[: offsets[-1]], starts[own], stops[own])
                        logs = net.log_probabilities(net.features(windows, tables))
                        np.add.at(total, rows[own[which]], logs * weight[:, None])
                    total[rows] /= np.maximum(1, np.diff(offsets))[:, None]
                best = total.argmax(1)
                share = np.exp(total - total.max(1, keepdims=True))
                share = share / share.sum(1, keepdims=True)
                langs = [net.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                scores = np.where(known, share[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_", "score_"])
        release()

    schema = T.StructType(list(plain.schema.fields)).add("lang_", T.StringType()).add("score_", T.DoubleType())
    bound_batches(docs.sparkSession)
    out = plain.mapInArrow(predicted, schema)
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*own, F.col("lang_").alias("lang_pred"), F.col("score_").alias("score"))


def _pieces(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Byte ranges that cover all texts; a cut inside a text falls between two windows."""
    out, lo, end = [], int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + size)
        k = int(np.searchsorted(offsets, hi, "right")) - 1
        if hi < end and offsets[k] < hi:
            begin = max(int(offsets[k]), lo) if offsets[k] > lo else int(offsets[k])
            hi = begin if begin > lo else int(offsets[k]) + (hi - int(offsets[k])) // WINDOW * WINDOW
        out.append((lo, hi))
        lo = hi
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
