"""Wavelet matrix over token ids: a succinct file that answers access, rank and occurrence queries.

Format ``WVM2`` (one record, all integers little-endian): magic, bit width (u8), tokens (u64),
documents (u64), then length-prefixed sections: zstd of doc_ids (i64), of their null mask and of document
lengths (u64); then, from the highest bit down, for every bit plane

- its rank directory: the ones before each block of 512 bits, and their total at last (u32),
- its select directories: the block that holds every 1,024th one, and every 1,024th zero (u32),
- its bits in zstd chunks of 8 KiB, each with its size, so that a query opens the chunks it touches only.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_BLOCK, _SAMPLE, _CHUNK = 512, 1024, 8192


def _pack(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + raw


def _zip(raw: bytes) -> bytes:
    return _pack(zstandard.ZstdCompressor(level=1).compress(raw))


def _plane(bits: np.ndarray) -> list[bytes]:
    """Directories and chunks of one plane."""
    packed = np.packbits(bits)
    packed = np.concatenate([packed, np.zeros(-len(packed) % (_BLOCK // 8), np.uint8)])
    ones = np.bitwise_count(packed).reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(ones)])
    zeros = np.minimum(np.arange(len(before)) * _BLOCK, len(bits)) - before
    held = [np.searchsorted(x, np.arange(0, int(x[-1]), _SAMPLE), "right") - 1 for x in (before, zeros)]
    press = zstandard.ZstdCompressor(level=1)
    chunks = [press.compress(packed[k : k + _CHUNK].tobytes()) for k in range(0, len(packed), _CHUNK)]
    sizes = np.array([len(c) for c in chunks], "<u4")
    return [_zip(x.astype("<u4").tobytes()) for x in (before, *held)] + [_pack(sizes.tobytes()), _pack(b"".join(chunks))]


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], width: int = 16) -> bytes:
    """Serialise the ids (uint16 or uint32) of consecutive documents."""
    seq = np.ascontiguousarray(ids)
    known = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    out = [b"WVM2", struct.pack("<BQQ", width, len(seq), len(doc_ids))]
    out += [_zip(known.tobytes()), _zip(nulls.tobytes()), _zip(np.array(lengths, "<u8").tobytes())]
    for level in range(width - 1, -1, -1):
        bits = (seq & seq.dtype.type(1 << level)) != 0
        out += _plane(bits)
        if level:
            parted, zeros = np.empty_like(seq), len(seq) - int(np.count_nonzero(bits))
            np.compress(~bits, seq, out=parted[:zeros])
            np.compress(bits, seq, out=parted[zeros:])
            seq = parted
    return b"".join(out)


class _Plane:
    """One plane of an opened record."""

    def __init__(self, parts: list[bytes], n: int) -> None:
        self.parts, self.n = parts, n
        self.begins = np.concatenate([[0], np.cumsum(np.frombuffer(parts[3], "<u4").astype(np.int64))])
        self.opened: dict[int, np.ndarray] = {}
        self.directories: list[np.ndarray] | None = None

    def _directory(self, k: int) -> np.ndarray:
        """0: ones before each block; 1, 2: blocks of every 1,024th one and zero."""
        if self.directories is None:
            open_ = zstandard.ZstdDecompressor().decompress
            self.directories = [np.frombuffer(open_(p), "<u4").astype(np.int64) for p in self.parts[:3]]
        return self.directories[k]

    def chunk(self, k: int) -> np.ndarray:
        raw = self.parts[4][int(self.begins[k]) : int(self.begins[k + 1])]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)

    def block(self, k: int) -> np.ndarray:
        """The 64 bytes of a block."""
        at, inside = divmod(k * (_BLOCK // 8), _CHUNK)
        if at not in self.opened:
            self.opened[at] = self.chunk(at)
        return self.opened[at][inside : inside + _BLOCK // 8]

    @property
    def zeros(self) -> int:
        return self.n - int(self._directory(0)[-1])

    def bit(self, i: int) -> int:
        return int(self.block(i // _BLOCK)[i % _BLOCK // 8] >> (7 - i % 8)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        k, rest = divmod(i, _BLOCK)
        ones = int(self._directory(0)[k])
        if rest:
            own = self.block(k)
            ones += int(np.bitwise_count(own[: rest // 8]).sum())
            ones += int(own[rest // 8] >> (8 - rest % 8)).bit_count() if rest % 8 else 0
        return ones

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value: directory, blocks between two samples, one block."""
        held, ones = self._directory(1 if bit else 2), self._directory(0)
        low = int(held[k // _SAMPLE])
        high = int(held[k // _SAMPLE + 1]) if k // _SAMPLE + 1 < len(held) else len(ones) - 2
        before = ones[low : high + 1]
        if not bit:
            before = np.arange(low, high + 1) * _BLOCK - before
        at = int(np.searchsorted(before, k, "right")) - 1
        where = np.flatnonzero(np.unpackbits(self.block(low + at)) == bit)
        return (low + at) * _BLOCK + int(where[k - int(before[at])])

    def bits(self) -> np.ndarray:
        whole = [self.chunk(k) for k in range(len(self.begins) - 1)] or [np.zeros(0, np.uint8)]
        return np.unpackbits(np.concatenate(whole), count=self.n).view(bool)


class WaveletMatrix:
    """An opened record.  Positions count from 0; every query costs one step a bit plane."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != b"WVM2":
            raise ValueError("not a WVM2 record")
        self.width, self.n, self.n_docs = struct.unpack_from("<BQQ", blob, 4)
        at, parts = 21, []
        for _ in range(3 + 5 * self.width):
            (size,) = struct.unpack_from("<Q", blob, at)
            parts.append(blob[at + 8 : at + 8 + size])
            at += 8 + size
        open_ = zstandard.ZstdDecompressor().decompress
        ids, nulls = np.frombuffer(open_(parts[0]), "<i8"), np.frombuffer(open_(parts[1]), np.uint8)
        self.doc_ids: list[int | None] = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(open_(parts[2]), "<u8").astype(np.int64)
        self.planes = [_Plane(parts[k : k + 5], self.n) for k in range(3, len(parts), 5)]

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank1(i)
            i = plane.zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = plane.rank1(low), plane.rank1(high)
            if token >> (self.width - 1 - level) & 1:
                low, high = plane.zeros + a, plane.zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token among the positions ``low <= i < high``."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            plane, bit = self.planes[level], token >> (self.width - 1 - level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids at once: undo the stable partitions from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bits = self.planes[level].bits()
            zeros = self.n - int(np.count_nonzero(bits))
            up = np.empty_like(ids)
            up[~bits] = ids[:zeros]
            up[bits] = ids[zeros:] | kind(1 << (self.width - 1 - level))
            ids = up
        return ids
