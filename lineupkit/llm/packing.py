"""Operator 9: hierarchical packing of documents into windows of several context sizes.

Every scan task packs the documents it reads, block by block: no shuffle, bounded memory.  Within a
block, stretches of ``context`` ids of long documents are windows of their own; each rest is routed to
the smallest tier (a power of two) that holds it.  From the longest tier down, every rest opens a
window of its tier and the gap is filled from shorter tiers: whole rests that fit best first, then
one cut.  What no shorter rest can fill is laid end to end and cut at powers of two, so no window is
padded.  Step groups collect windows until they hold ``group_tokens`` ids, the longest windows dealt
first and each to the group that holds least, so groups carry like work.

A sequence id is ``scan partition << 32 | number``; it repeats while the input files and their splits do.

Nulls and edge cases: a null text is the end id alone; null and repeated doc_ids are packed like
others, each row on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm import bpe_words
from lineupkit.llm.workers import bound_batches, release
from lineupkit.runtime import table

#: (document number in the block, first id, number of ids)
Piece = tuple[int, int, int]
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, context long, step_group long"
)


def pack(lengths: list[int], context: int = 4096, smallest_tier: int = 256) -> list[tuple[int, list[Piece]]]:
    """Windows (context size, pieces in order) that hold every id of every document once."""
    windows: list[tuple[int, list[Piece]]] = []
    rests: list[tuple[int, int, int]] = []  # (length, document, first id), ascending
    for doc, n in enumerate(lengths):
        full = n - n % context
        windows += [(context, [(doc, at, context)]) for at in range(0, full, context)]
        if n > full:
            rests.append((n - full, doc, full))
    rests.sort()
    tier, loose = context, []
    while tier >= smallest_tier and rests:
        # A rest above half the tier opens a window; at the lowest tier every rest does.
        low = tier // 2 if tier > smallest_tier else 0
        while rests and rests[-1][0] > low:
            n, doc, at = rests.pop()
            window, gap = [(doc, at, n)], tier - n
            while gap and rests:
                fits = bisect_right(rests, (gap, 1 << 62, 0)) - 1
                if fits >= 0:
                    m, other, first = rests.pop(fits)
                    window.append((other, first, m))
                else:  # all rests are longer than the gap: cut the shortest
                    m, other, first = rests.pop(0)
                    window.append((other, first, gap))
                    insort(rests, (m - gap, other, first + gap))
                    m = gap
                gap -= m
            if gap:
                loose += window
            else:
                windows.append((tier, window))
        tier //= 2
    # The last few hundred or thousand ids of a block: exact powers of two.
    left = sum(n for _, _, n in loose)
    queue = iter(loose)
    doc, at, n = next(queue, (0, 0, 0))
    while left:
        size = min(context, 1 << (left.bit_length() - 1))
        window, need = [], size
        while need:
            if not n:
                doc, at, n = next(queue)
            m = min(n, need)
            window.append((doc, at, m))
            at, n, need = at + m, n - m, need - m
        windows.append((size, window))
        left -= size
    return windows


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A group for each window; the groups' sizes differ by one window at most."""
    groups = max(1, -(-sum(sizes) // group_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, g = heap[0]
        heapq.heapreplace(heap, (size + sizes[k], g))
        out[k] = g
    return out


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 2,
    context: int = 4096,
    block_tokens: int = 8_000_000,
    group_tokens: int = 524_288,
    keep: list[str] | None = None,
    with_ids: bool = False,
    table_words: int = bpe_words.MAX_WORDS,
) -> DataFrame:
    """The pieces of all windows (``PIECES``), with the columns ``keep`` of the documents before them.

    ``with_ids`` adds ``ids``, the piece's ids as little-endian uint16: what a trainer reads.
    ``table_words`` bounds the encoder's table in each worker.
    """
    vocabulary = vocabulary or bpe_words.default_path()
    keep = keep or []

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, base = bpe_words.encoder(vocabulary), TaskContext.get().partitionId() << 32
        held: list[bytes] = []
        rows: list[pd.DataFrame] = []
        made = groups = size = 0

        def close() -> pd.DataFrame:
            nonlocal held, rows, made, groups, size
            windows = pack([len(h) // 2 for h in held], context)
            chosen = step_groups([w for w, _ in windows], group_tokens)
            wide: dict[int, memoryview] = {}
            out = []
            for (kind, pieces), group in zip(windows, chosen, strict=True):
                offset = 0
                for doc, at, n in pieces:
                    if doc not in wide:
                        wide[doc] = memoryview(np.frombuffer(held[doc], "<u2").astype("<u4").tobytes())
                    crc = zlib.crc32(wide[doc][4 * at : 4 * (at + n)])
                    row = (doc, at, n, crc, len(held[doc]) // 2, base + made, offset, kind, base + groups + group)
                    out.append((*row, held[doc][2 * at : 2 * (at + n)]) if with_ids else row)
                    offset += n
                made += 1
            groups += max(chosen, default=-1) + 1
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
            names += ["ids"] if with_ids else []
            found = pd.DataFrame(out, columns=names)
            own = pd.concat(rows, ignore_index=True).iloc[found.pop("doc").to_numpy()].reset_index(drop=True)
            held, rows, size = [], [], 0
            return pd.concat([own, found], axis=1)

        for batch in batches:
            for first in range(0, len(batch), 256):
                some = batch.iloc[first : first + 256]
                found = encoder.encode(some["text_"].tolist(), end_id, table_words)
                held += found
                rows.append(some.drop(columns="text_"))
                size += sum(map(len, found)) // 2
                if size >= block_tokens:
                    yield close()
        if held:
            yield close()
        if table_words < bpe_words.MAX_WORDS:
            encoder.forget()
        release()

    # Columns are told apart by place, so those of the documents may have any name.
    head = [F.col(c).alias(f"k{i}_") for i, c in enumerate(keep)]
    rows = docs.select(*head, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text_"))
    kinds = "".join(f"k{i}_ {rows.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    bound_batches(docs.sparkSession)
    pieces = PIECES + (", ids binary" if with_ids else "")
    out = rows.mapInPandas(packed, kinds + pieces)
    return out.select(*[F.col(f"k{i}_").alias(c) for i, c in enumerate(keep)], *[p.split()[0] for p in pieces.split(", ")])


def op9_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed for a context of 4,096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
