"""Encoding texts with the tokenizers library, each distinct word once.

Tokenizers that drop white space and never join characters across it give a
text the ids of its words, one after the other.  A worker keeps the ids of
words it has met in a hash table over numpy arrays; only unseen words go
through the library.  The table has a bound and starts afresh beyond it.
"""

from __future__ import annotations

import os

import numpy as np

from plantpulse.llm import textbuf

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
U64 = np.uint64


class Memo:
    """hash -> ids, by open addressing; grows by doubling up to a bound.

    A million words take some 60 MB: ids of vocabularies under 65536 entries
    are kept in two bytes.
    """

    def __init__(self, vocabulary: int, most: int = 1 << 20):
        self.most, self.kind = most, np.uint16 if vocabulary <= 65536 else np.uint32
        self.clear(1 << 17)

    def clear(self, size: int) -> None:
        self.keys = np.zeros(size, U64)
        self.slots = np.zeros(size, np.int32)
        self.used = 0
        self.begin = np.zeros(1024, np.uint32)
        self.length = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, self.kind)
        self.filled = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry number of each hash, or -1."""
        mask = U64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == hashes, self.slots[at], -1)
        open_ = np.flatnonzero((have != hashes) & (have != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(mask)
            have = self.keys[at[open_]]
            hit = have == hashes[open_]
            out[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (have != 0)]
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & U64(mask)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = open_[self.keys[at[open_]] == 0]
            self.keys[at[free]] = hashes[free]  # of several for one slot the last stays
            won = self.keys[at[free]] == hashes[free]
            self.slots[at[free[won]]] = numbers[free[won]]
            placed = np.zeros(len(hashes), bool)
            placed[free[won]] = True
            open_ = open_[~placed[open_]]
            at[open_] = (at[open_] + 1) & mask

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new hashes with their ids, one after the other."""
        n, m = len(hashes), len(ids)
        if 2 * (self.used + n) > len(self.keys):
            size = len(self.keys)
            while 2 * (self.used + n) > size:
                size *= 2
            old, numbers = self.keys, self.slots
            self.keys, self.slots = np.zeros(size, U64), np.zeros(size, np.int32)
            full = old != 0
            self._insert(old[full], numbers[full])
        for name, need in (("begin", self.used + n), ("length", self.used + n), ("ids", self.filled + m)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
        self.begin[self.used : self.used + n] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.used : self.used + n] = lengths
        self.ids[self.filled : self.filled + m] = ids
        self._insert(hashes, np.arange(self.used, self.used + n, dtype=np.int32))
        self.used += n
        self.filled += m

    def lookup(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all in a row, how many each has); ``encode(positions)``
        gives (lengths, ids) for the first places of unseen hashes."""
        if self.used > self.most:
            self.clear(1 << 17)
        number = self.find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            self.add(fresh, *encode(missing[first]))
            number[missing] = self.find(hashes[missing])
        lengths = self.length[number].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begin[number].astype(np.int64) - (ends - lengths), lengths)]
        return ids.astype(np.uint32), lengths


_WORKERS: dict[str, tuple] = {}


def worker(path: str):
    """(tokenizer, memo) of this Python worker."""
    if path not in _WORKERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _WORKERS[path] = (t, Memo(t.get_vocab_size(with_added_tokens=True)))
    return _WORKERS[path]


def encode(texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each text has); null is empty."""
    tokenizer, memo = worker(path)
    buf, offs = textbuf.flat(texts)
    ws, we = textbuf.words(buf, offs)
    hashes = textbuf.span_hashes(buf, ws, we)

    def unseen(at):
        raw = buf.tobytes()
        found = tokenizer.encode_batch_fast([raw[i:j].decode() for i, j in zip(ws[at].tolist(), we[at].tolist())], add_special_tokens=False)
        ids = [e.ids for e in found]
        return np.array([len(x) for x in ids], np.int64), np.array([y for x in ids for y in x], np.uint32)

    ids, lengths = memo.lookup(hashes, unseen)
    first = np.searchsorted(ws, offs)
    bounds = np.concatenate([[0], np.cumsum(lengths)])[first]
    return ids, np.diff(bounds)
