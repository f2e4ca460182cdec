"""Operator 2: token ids in binary shards, each one compressed wavelet-matrix record.

Documents are put in ascending ``doc_id`` order by a range shuffle; each task encodes its documents and
closes a shard whenever it holds ``shard_tokens`` ids (a size at which a plane is partitioned within the
processor's cache).  Spark's own Parquet writer commits the shards, one record each and one file a
task, so any file system works and a lost executor only repeats its task.

Nulls and edge cases: a null text has the end id alone; null doc_ids come first; repeated doc_ids
stay side by side, one result row each; an empty table writes no shard and reads back as no rows;
other columns are ignored.  Texts reach a worker in batches of a few MB; a text longer than that, and the record that
it closes, are held whole by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.llm import bpe_words
from lineupkit.llm.wavelet import WaveletMatrix, build
from lineupkit.llm.workers import bound_batches, release
from lineupkit.runtime import table, work_path

_SHARD = "part int, seq int, first_doc long, n_docs long, n_tokens long, wavelet binary"


def write_shards(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = 1_000_000
) -> None:
    """Encode ``docs`` (doc_id, text) and write its shards below ``path`` in doc_id order."""
    vocabulary = vocabulary or bpe_words.default_path()

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq = bpe_words.encoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal held, ids, size, seq
            raw = b"".join(held)
            blob = build(np.frombuffer(raw, "<u2"), ids, [len(h) // 2 for h in held])
            row = (part, seq, ids[0], len(ids), len(raw) // 2, blob)
            held, ids, size, seq = [], [], 0, seq + 1
            return pd.DataFrame([row], columns=["part", "seq", "first_doc", "n_docs", "n_tokens", "wavelet"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                found = encoder.encode(some["text"].tolist(), end_id)
                for doc, null, got in zip(some["doc_id"].tolist(), some["doc_id"].isna().tolist(), found, strict=True):
                    held.append(got)
                    ids.append(None if null else int(doc))
                    size += len(got) // 2
                    if size >= shard_tokens:
                        yield close()
        if held:
            yield close()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    bound_batches(docs.sparkSession)
    out = ordered.mapInPandas(shards, _SHARD)
    out.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder, one row each."""
    return spark.read.schema(_SHARD).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """Per shard the number of ids in all shards before it (one short row a shard)."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part", "seq")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = shards.select("part", "seq", "first_doc", "n_tokens")
    return kept.withColumn("before", F.coalesce(before, F.lit(0))).select("part", "seq", "before")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode shards: per document its global start, number of ids and their checksum."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, blob in zip(batch["part"], batch["seq"], batch["wavelet"], strict=True):
                shard = WaveletMatrix(blob)
                ids, stops = shard.decode().astype("<u4"), np.cumsum(shard.lengths)
                begins = stops - shard.lengths
                sums = [zlib.crc32(ids[a:b].data) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
                docs = pd.array(shard.doc_ids, "Int64")
                columns = {"part": part, "seq": seq, "doc_id": docs, "at": begins}
                yield pd.DataFrame(columns | {"n_tokens": shard.lengths, "ids_crc32": sums})

    kind = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"
    # Batches of one record: a record is a few MB, and a batch must fit the worker.
    found = shards.select("part", "seq", "wavelet").mapInPandas(decode, kind)
    placed = found.join(shard_starts(shards), ["part", "seq"])
    return placed.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids through the files and back."""
    path = work_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_documents(read_shards(spark, path))
