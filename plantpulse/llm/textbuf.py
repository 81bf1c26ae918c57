"""Array kernels over Arrow string buffers, shared by the text operators.

A batch of texts is one byte buffer plus offsets (Arrow's own layout), so
splitting into words, hashing words and rolling windows over them are a few
numpy passes, with no Python object per word.  All functions are pure; every
hash is a fixed function of the bytes, so any task on any machine gives the
same value and a retried task repeats its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multipliers of the 64-bit mixers; any odd constants of good spread do.
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U64) + U64(seed)) * _GOLD + U64(seed))


_BYTE = {s: _table(1000 * s + 17, 256) for s in (1, 2)}
_BASE = {1: U64(0x9E6C63D0876A9A35), 2: U64(0xC2B2AE3D27D4EB4F)}


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_POW: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, inverse: bool, n: int) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    have = _POW.get((seed, inverse))
    if have is None or len(have) < n:
        base = int(_BASE[seed])
        base = U64(_inverse(base) if inverse else base)
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.empty(size, U64)
        out[0], filled = 1, 1
        step = base
        with np.errstate(over="ignore"):
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * step
                step = step * step
                filled *= 2
        _POW[seed, inverse] = have = out
    return have[:n]


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        empty = b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else ""
        texts = pc.fill_null(texts, pa.scalar(empty, texts.type))
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    if n == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that stay within one text."""
    n = len(member)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins, stops = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    stops[:-1] &= ~member[1:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = member[cut]
    stops[cut - 1] = member[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    return runs(~_SEP[buf], offs)


def counts(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each text."""
    return np.diff(np.searchsorted(starts, offs))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are sorted and don't overlap."""
    if len(starts) == 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        p = _BYTE[seed][buf]
        p *= _powers(seed, False, len(buf))
        np.cumsum(p, out=p)
        total = p[ends - 1]
        later = starts > 0
        total[later] -= p[starts[later] - 1]
        total *= _powers(seed, True, len(buf))[starts]
        total += (ends - starts).astype(U64) * _GOLD
        return mix(total)


def rolling(values: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of every k consecutive values; len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        p = values * _powers(seed, False, len(values))
        np.cumsum(p, out=p)
        out = p[k - 1 :].copy()
        out[1:] -= p[: n - 1]
        out *= _powers(seed, True, len(values))[:n]
        return mix(out)


def inside(per_text: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k over all texts' items in a row lie in one text.

    ``per_text`` counts each text's items.  True at the window's first item;
    the result has one entry for each of the sum(per_text) - k + 1 windows.
    """
    total = int(per_text.sum())
    ok = np.zeros(max(total - k + 1, 0), bool)
    if len(ok) == 0:
        return ok
    ends = np.cumsum(per_text)
    starts = ends - per_text
    good = per_text >= k
    mark = np.zeros(total + 1, np.int32)
    np.add.at(mark, starts[good], 1)
    np.add.at(mark, ends[good] - k + 1, -1)
    return np.cumsum(mark)[: len(ok)] > 0


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items are covered by a window of that width at any start."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + width, n), -1)
    return np.cumsum(mark)[:n] > 0


def owner(per_text: np.ndarray) -> np.ndarray:
    """The index of the text that each item belongs to."""
    return np.repeat(np.arange(len(per_text)), per_text)


def value_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each span of 64-bit values (spans are not empty)."""
    if len(starts) == 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        p = values * _powers(seed, False, len(values))
        np.cumsum(p, out=p)
        total = p[ends - 1]
        later = starts > 0
        total[later] -= p[starts[later] - 1]
        total *= _powers(seed, True, len(values))[starts]
        total += (ends - starts).astype(U64) * _GOLD
        return mix(total)


def sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offs])


#: Most rows of a slice, so that a row's number fits 14 bits of a sort key.
MAX_ROWS = 1 << 14


def slices(batches, column: str, max_bytes: int = 1_000_000):
    """Cut Arrow batches by their text bytes, so that arrays stay in cache.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = min(max(lo + 1, int(np.searchsorted(ends, base + max_bytes, "right"))), lo + MAX_ROWS)
            yield batch.slice(lo, hi - lo)
            lo = hi


def lists(per_row: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array with that many values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), values)


def group_chunks(batches, column: str, max_bytes: int = 8_000_000):
    """Re-cut batches sorted by an integer column: (table, unfinished group).

    A table holds whole groups, with None, or a part of the one group named,
    which exceeds ``max_bytes``; its next rows, if any, follow at once.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        size += b.nbytes
        if size < max_bytes:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks(), None
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
        else:
            yield table.combine_chunks(), int(values[-1])
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), None


def whole_groups(batches, column: str, max_bytes: int = 8_000_000):
    """Re-cut batches sorted by an integer column so that no group is divided."""
    parts: list[pa.Table] = []
    for table, unfinished in group_chunks(batches, column, max_bytes):
        if parts:
            values, open_ = table.column(column).to_numpy(), parts[-1].column(column)[-1].as_py()
            cut = int(np.searchsorted(values, open_, "right"))
            parts.append(table.slice(0, cut))
            if unfinished == open_:
                continue
            yield pa.concat_tables(parts).combine_chunks()
            parts, table = [], table.slice(cut)
        if unfinished is not None:
            parts = [table]
        elif table.num_rows:
            yield table.combine_chunks()
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def group_bounds(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    if len(values) == 0:
        return []
    at = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]).tolist()
    return list(zip(at[:-1], at[1:]))
