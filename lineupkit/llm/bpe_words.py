"""Exact ids of whole texts for the lower-casing word BPE, one lookup a white-space word.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its words
in order.  Each Python worker keeps a bounded table word -> ids; unknown words of a whole batch are
encoded together by the library.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np

#: Words kept in a worker's table before it drops the later half, and the longest word that is kept.
MAX_WORDS, MAX_WORD = 900_000, 64

#: Marks that are a token of their own after a letter.
MARKS = ".,|!?;:"

_encoders: dict[str, WordEncoder] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _is_plain(word: str) -> bool:
    return word.isalpha() and word.islower() and (word.isascii() or max(word) <= "\xff")


class _Table(dict):
    """word -> ids as bytes; an unknown word gets an empty slot that is filled later."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.fresh: list[str] = []
        self.loose: dict[str, bytearray] = {}

    def __missing__(self, word: str) -> bytearray:
        slot = bytearray()
        if len(word) > MAX_WORD:
            return self.loose.setdefault(word, slot)
        self[word] = slot
        self.pending.append(word)
        return slot

    def settle(self) -> None:
        """Filled slots become plain bytes, which take half the room."""
        for word in self.fresh:
            self[word] = bytes(self[word])
        self.fresh = []


class WordEncoder:
    """Encode texts to arrays of uint16 ids (the vocabulary has fewer than 65,536 entries)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.normalizers import Sequence

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for lower-case Latin-1 letters: nothing to normalise
        self.plain.normalizer = Sequence([])
        steps = [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(steps)
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.full.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Drop the table, which a worker would else hold between its tasks."""
        self.table = _Table()
        self.table[""] = b""

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.full.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, np.uint16).tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters: each ends at the token that carries the end mark."""
        out: list[bytes] = []
        texts = [" ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        for found in self.plain.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, np.uint16)
            raw, last = ids.tobytes(), 0
            for stop in (np.flatnonzero(self.ends[ids]) * 2 + 2).tolist():
                out.append(raw[last:stop])
                last = stop
        return out

    def _fill(self) -> None:
        table, todo = self.table, self.table.pending
        table.pending, table.fresh = [], todo
        marked = [w for w in todo if w[-1] in MARKS and _is_plain(w[:-1])]
        plain = [w for w in todo if w[-1] not in MARKS and _is_plain(w)]
        known = set(plain)
        stems = [w for w in {m[:-1] for m in marked} if w not in known and not table.get(w)]
        fresh = dict(zip(plain + stems, self._letters(plain + stems), strict=True))
        for word in plain:
            table[word] += fresh[word]
        marks = {m: self._library([m])[0] for m in {w[-1] for w in marked}}
        for word in marked:
            stem = word[:-1]
            table[word] += (fresh.get(stem) or bytes(table[stem])) + marks[word[-1]]
        other = [w for w in todo if not table[w]]
        for word, ids in zip(other, self._library(other) if other else [], strict=True):
            table[word] += ids
        if table.loose:
            for slot, ids in zip(table.loose.values(), self._library(list(table.loose)), strict=True):
                slot.extend(ids)
            table.loose = {}

    def _words(self, text: str) -> list[str]:
        """The words; Latin-1 text is in normal form already, so it may be lower-cased at once.

        Added tokens are matched before anything is lower-cased, so a text in which lower case would
        make one is left to the library as it stands.
        """
        text = text.replace("\n", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split(" ")
        low = text.lower()
        return (text if any(s in low for s in self.special) else low).split(" ")

    def encode(self, texts: list[str | None], end: int, max_words: int = MAX_WORDS) -> list[bytes]:
        """The ids of each text and ``end`` after them, as little-endian uint16; null is empty.

        ``max_words`` bounds the table (about 150 bytes a word); it changes the work, not the ids.
        """
        stop, look = np.array([end], "<u2").tobytes(), self.table.__getitem__
        parts = [list(map(look, self._words(t))) if t else [] for t in texts]
        if self.table.pending or self.table.loose:
            self._fill()
        out = [b"".join(p) + stop for p in parts]
        self.table.settle()
        if len(self.table) > max_words:  # the words met first are the frequent ones
            kept = _Table()
            kept.update(islice(self.table.items(), max_words // 2))
            self.table = kept
        return out


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
