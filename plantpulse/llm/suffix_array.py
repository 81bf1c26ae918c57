"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as S (less than the next suffix) or L.  The leftmost S
suffixes of each S stretch (LMS) cut the text into substrings; these are
sorted by one induction, named, and, if names repeat, the string of names is
sorted recursively.  The sorted LMS suffixes then induce all others.

Induction goes through the buckets of first characters in order.  What a
bucket holds when its turn comes is final, so all its predecessors are placed
with one stable counting sort; only predecessors that fall into the same
bucket make another wave (as many waves as the longest run of one character).
Work is linear, and each step is a numpy pass.  Strings of names have too many
buckets for that; there a suffix is placed by its symbols up to the next LMS
suffix and that one's rank, all suffixes at once, symbol after symbol, with
only those still tied in play.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is S; the last position is an S sentinel."""
    n = len(s)
    known = np.ones(n, bool)
    less = np.ones(n, bool)
    known[:-1] = s[:-1] != s[1:]
    less[:-1] = s[:-1] < s[1:]
    at = np.where(known, np.arange(n), n - 1)
    return less[np.minimum.accumulate(at[::-1])[::-1]]


class _Buckets:
    """Growing parts of each bucket, kept as lists of arrays in order."""

    def __init__(self, k: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(k)]

    def put(self, positions: np.ndarray, chars: np.ndarray) -> None:
        """Append positions to their characters' buckets, in order."""
        if len(positions) == 0:
            return
        order = np.argsort(chars, kind="stable")
        chars, positions = chars[order], positions[order]
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        for c, part in zip(chars[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            self.parts[c].append(part)

    def get(self, c: int) -> np.ndarray:
        return np.concatenate(self.parts[c]) if self.parts[c] else np.empty(0, np.int64)


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from LMS positions in order within buckets."""
    narrow = s.astype(np.uint16) if k <= 65536 else s
    heads, tails = _Buckets(k), _Buckets(k)
    seeds = _Buckets(k)
    seeds.put(lms, narrow[lms])
    for c in range(k):  # L suffixes, buckets upwards
        wave = heads.get(c)
        done = [wave]
        while len(wave):
            before = wave - 1
            before = before[(wave > 0) & ~is_s[before]]
            ch = narrow[before]
            same = ch == c
            heads.put(before[~same], ch[~same])
            wave = before[same]
            done.append(wave)
        heads.parts[c] = [np.concatenate(done)]
        seed = seeds.get(c)
        before = seed[seed > 0] - 1
        before = before[~is_s[before]]
        heads.put(before, narrow[before])
    for c in range(k - 1, -1, -1):  # S suffixes, buckets downwards, each from its end
        wave = tails.get(c)
        done = [wave]
        while len(wave):
            before = wave - 1
            before = before[(wave > 0) & is_s[before]]
            ch = narrow[before]
            same = ch == c
            tails.put(before[~same], ch[~same])
            wave = before[same]
            done.append(wave)
        tails.parts[c] = [np.concatenate(done)]
        own = heads.get(c)[::-1]
        before = own[own > 0] - 1
        before = before[is_s[before]]
        tails.put(before, narrow[before])
    out = []
    for c in range(k):
        out.append(heads.get(c))
        out.append(tails.get(c)[::-1])
    # the sentinel is an S suffix that nothing precedes
    return np.concatenate([np.array([len(s) - 1]), *out])


def _place(s: np.ndarray, is_s: np.ndarray, is_lms: np.ndarray, rank: np.ndarray | None) -> np.ndarray:
    """Order numbers of suffixes by what stands up to the next LMS position.

    With ``rank`` (of LMS suffixes, by position): of all suffixes, in full
    order.  Without: of LMS positions, by their LMS substrings alone; equal
    substrings get equal numbers.  Suffixes equal so far, in symbols and types,
    reach their next LMS positions together, so comparison never runs on alone.
    """
    start = np.flatnonzero(is_lms) if rank is None else np.arange(len(s))
    number = np.zeros(len(start), np.int64)
    open_, step = np.arange(len(start)), 0
    while len(open_):
        at = start[open_] + step
        # the last suffix is the sentinel, which no other equals
        ended = is_lms[at] & ((step > 0) | (at == len(s) - 1))
        key = 2 * s[at] + is_s[at]
        if rank is not None:  # equal in symbol and type: all ended or none
            key = key * len(s) + np.where(ended, rank[at], 0)
        order = np.lexsort((key, number[open_]))
        open_, key, ended = open_[order], key[order], ended[order]
        group = number[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        head = np.ones(len(open_), bool)
        head[1:] = group[1:] != group[:-1]
        index = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(head, index, 0))
        number[open_] = group + np.maximum.accumulate(np.where(new, index, 0)) - first
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = open_[~alone & ~ended]
        step += 1
    return number


def _names(s: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal numbers for equal LMS substrings, in their sorted order."""
    n = len(s)
    length = np.empty(n + 1, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ranked[:-1], ranked[1:]
    differ = length[a] != length[b]
    # compare what has equal length, 1 character further each round
    open_ = np.flatnonzero(~differ)
    step = 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        unlike = s[x] != s[y]
        differ[open_[unlike]] = True
        step += 1
        open_ = open_[~unlike & (length[a[open_]] > step)]
    rank = np.concatenate([[0], np.cumsum(differ)])
    name = np.empty(n, np.int64)
    name[ranked] = rank
    return name[lms], int(rank[-1]) + 1


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Start positions of all suffixes in order.

    ``s``: integers below ``k`` whose last one, 0, occurs nowhere else.
    """
    s = np.asarray(s, np.int64)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = _types(s)
    is_lms = is_s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    wide = k > 2048
    if len(lms) > 1:
        if wide:
            number = _place(s, is_s, is_lms, None)
            distinct, name = np.unique(number, return_inverse=True)
            used = len(distinct)
        else:
            sa = _induce(s, is_s, lms, k)
            name, used = _names(s, lms, sa[is_lms[sa]])
        # the last LMS suffix is the sentinel: its name, 0, is unique
        lms = lms[np.argsort(name)] if used == len(lms) else lms[suffix_array(name, used)]
    if not wide:
        return _induce(s, is_s, lms, k)
    rank = np.zeros(n, np.int64)
    rank[lms] = np.arange(len(lms))
    return np.argsort(_place(s, is_s, is_lms, rank))


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position: the common prefix with the suffix just before in order.

    Where the characters before two neighbours are equal, the value is that of
    the previous position less one; only the other positions are compared,
    all at once, and the rest follows.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    hard = (before <= 0) | (at == 0) | (s[np.maximum(at - 1, 0)] != s[np.maximum(before - 1, 0)])
    length = np.zeros(n, np.int64)
    open_ = np.flatnonzero(hard & (before >= 0))
    while len(open_):
        i, j = open_ + length[open_], before[open_] + length[open_]
        # neither runs off the end: the unique sentinel differs first
        more = s[i] == s[j]
        open_ = open_[more]
        length[open_] += 1
    # between hard positions the value falls by one a step
    key = np.where(hard, length + at, -1)
    last = np.maximum.accumulate(np.where(hard, at, 0))
    return np.maximum(key[last] - at, 0)
