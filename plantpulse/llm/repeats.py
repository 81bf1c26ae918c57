"""Shared steps of the two exact repeat finders (word windows and byte strings).

A window is K consecutive items of one document.  Its anchor is the least
hashed gram of g items inside it (the leftmost of equals), a function of the
window's content alone: equal windows have equal anchors at equal offsets.
Neighbouring windows share anchors, so a document becomes a list of short
runs of windows, each under one anchor, and everything below moves runs.

1. ``sketch``: every partition counts its runs' anchors in a count-min sketch
   (two rows of counters, sent sparse, in segments); the segments are added up
   and kept as one bit a cell ("twice or more") and a list of the hot cells.
   An anchor's count is at least that of each of its windows, so the merged
   sketch overestimates window counts and loses no repeated window.
2. ``candidates``: a second scan keeps the runs whose anchor is estimated
   repeated.  Runs under a hot anchor are divided by where the anchor stands in
   their windows and named anew by the content that those windows share, so
   that equal windows still meet and different ones part (``divided``).
   Repeats among the documents at hand are settled: runs whose windows all
   occur earlier among those need no partner any more and leave at once, one
   row a document.
3. An exact step by anchor (hash groups or suffix arrays) marks windows that
   also start earlier, a row for each run that has some.

The sketch's width follows the corpus up to ``max_cells``; beyond, more runs
pass the filter, and the exact step still decides: results don't depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf

U64 = np.uint64
#: Runs from which an anchor is hot.
HOT = 50_000
#: Cells of one segment of a sketch row.
SEGMENT_BITS = 18
CANDIDATES = "anchor long, doc_id long, row_key long, start int, n int, data binary, runs binary"
_COLUMNS = [c.split()[0] for c in CANDIDATES.split(", ")]
REMOVED = "doc_id long, row_key long, runs binary"


@dataclass(frozen=True)
class Windows:
    """``width`` items a window; anchors are grams of ``gram`` items.
    ``of_bytes``: items are bytes, else words.  An anchor of ``hot`` runs or
    more has its runs divided into ``parts``."""

    width: int
    gram: int
    of_bytes: bool
    max_cells: int = 1 << 31
    hot: int = HOT
    parts: int = 8


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, text): rows that repeat an id count as documents of
    their own, ordered by the hash of their text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _items(batch, w: Windows):
    """Item values, items per text, and where items start in the bytes."""
    buf, offs = textbuf.flat(batch.column("text"))
    if w.of_bytes:
        return textbuf._BYTE[1][buf], np.diff(offs), buf
    ws, we = textbuf.words(buf, offs)
    return textbuf.span_hashes(buf, ws, we), textbuf.counts(ws, offs), None


def runs(values: np.ndarray, per_text: np.ndarray, w: Windows):
    """(first window, windows, anchor hash, anchor position) of every run.

    Windows are numbered by their first item over all texts of the slice.
    """
    ok = textbuf.inside(per_text, w.width)
    none = np.empty(0, np.int64)
    if not ok.any():
        return none, none, np.empty(0, U64), none
    grams = textbuf.rolling(values, w.gram)
    span = w.width - w.gram + 1
    bits = U64(max(1, int(len(grams)).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        step = span - size
        least = np.minimum(least[:-step], least[step:])
    at = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    head = ok.copy()
    head[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    ends = np.cumsum(per_text)
    firsts = (ends - per_text)[per_text > 0]
    firsts = firsts[firsts < len(ok)]
    head[firsts] = ok[firsts]
    start = np.flatnonzero(head)
    # a run ends before the next head or the next window that is not whole
    stop = np.empty(len(start), np.int64)
    stop[:-1], stop[-1] = start[1:], len(ok)
    bad = np.flatnonzero(~ok)
    if len(bad):
        nxt = np.searchsorted(bad, start)
        stop = np.minimum(stop, np.where(nxt < len(bad), bad[np.minimum(nxt, len(bad) - 1)], len(ok)))
    return start, stop - start, grams[at[start]], at[start]


def _cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return anchors >> U64(64 - bits), textbuf.mix(anchors + textbuf._GOLD) >> U64(64 - bits)


def _sketch_part(w: Windows, bits: int):
    def run(batches):
        seen = []
        for b in textbuf.slices(batches, "text"):
            values, per, _ = _items(b, w)
            seen.append(runs(values, per, w)[2])
        if not seen:
            return
        anchors = np.concatenate(seen)
        for row, cells in enumerate(_cells(anchors, bits)):
            cells, n = np.unique(cells, return_counts=True)
            packed = ((cells & U64((1 << SEGMENT_BITS) - 1)) << U64(2) | np.minimum(n, 3).astype(U64)).astype("<u4")
            n = n.astype("<u4")
            segment = (cells >> U64(SEGMENT_BITS)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.empty(0, np.int64)
            stops = np.append(at[1:], len(segment))
            for lo in range(0, len(at), 256):
                a, z = at[lo : lo + 256], stops[lo : lo + 256]
                yield pa.record_batch([pa.array([row] * len(a), pa.int32()), pa.array(segment[a].astype(np.int32)), pa.array([packed[i:j].tobytes() for i, j in zip(a, z)], pa.binary()), pa.array([n[i:j][n[i:j] > 2].tobytes() for i, j in zip(a, z)], pa.binary())], ["row", "segment", "part", "more"])

    return run


def _add_parts(hot: int):
    """Add up the parts of each (row, segment); they arrive sorted.

    A part's counts of 3 and more stand in ``more``, in the order of its cells.
    """

    def run(batches):
        key, total = None, None

        def merged():
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary()), pa.array([np.flatnonzero(total >= hot).astype("<u4").tobytes()], pa.binary())], ["row", "segment", "repeated", "hot"])

        for b in batches:
            for row, segment, part, more in zip(b.column("row").to_pylist(), b.column("segment").to_pylist(), b.column("part"), b.column("more")):
                if (row, segment) != key:
                    if key is not None:
                        yield merged()
                    key, total = (row, segment), np.zeros(1 << SEGMENT_BITS, np.int64)
                packed = np.frombuffer(part.as_buffer(), "<u4")
                n = (packed & 3).astype(np.int64)
                n[n == 3] = np.frombuffer(more.as_buffer(), "<u4")
                total[packed >> 2] += n
        if key is not None:
            yield merged()

    return run


def sketch(rows: DataFrame, w: Windows, path: str) -> int:
    """Write the merged sketch under ``path``; the bits of a row's width."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_run = (w.width - w.gram + 2) / 2 * (1 if w.of_bytes else 6)
    bits = int(min(max(SEGMENT_BITS, np.ceil(np.log2(8 * total / per_run + 1))), np.log2(w.max_cells)))
    parts = rows.select("text").mapInArrow(_sketch_part(w, bits), "row int, segment int, part binary, more binary")
    merged = parts.repartition("row", "segment").sortWithinPartitions("row", "segment").mapInArrow(_add_parts(w.hot), "row int, segment int, repeated binary, hot binary")
    scratch.stored(merged, path)
    return bits


_LOADED: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def _load(path: str, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row of the merged sketch as bitmap and sorted hot cells, kept by the Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        size = (1 << SEGMENT_BITS) // 8
        rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
        hot: list[list[np.ndarray]] = [[], []]
        fs, where = pafs.FileSystem.from_uri(path)
        for info in fs.get_file_info(pafs.FileSelector(where)):
            if info.path.endswith(".parquet"):
                for b in pq.ParquetFile(fs.open_input_file(info.path)).iter_batches(64):
                    for row, segment, bitmap, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                        rows[row][segment * size : (segment + 1) * size] = np.frombuffer(bitmap.as_buffer(), np.uint8)
                        hot[row].append(np.frombuffer(cells.as_buffer(), "<u4").astype(U64) | U64(segment << SEGMENT_BITS))
        _LOADED[path] = [(r, np.sort(np.concatenate(h)) if h else np.empty(0, U64)) for r, h in zip(rows, hot)]
    return _LOADED[path]


def estimated_repeated(anchors: np.ndarray, path: str, bits: int) -> np.ndarray:
    keep = np.ones(len(anchors), bool)
    for (bitmap, _), cells in zip(_load(path, bits), _cells(anchors, bits)):
        keep &= (bitmap[cells >> U64(3)] >> (cells & U64(7)).astype(np.uint8)) & 1 == 1
    return keep


def estimated_hot(anchors: np.ndarray, path: str, bits: int) -> np.ndarray:
    """Whether an anchor may have the sketch's hot count: true for all that have."""
    out = np.ones(len(anchors), bool)
    for (_, hot), cells in zip(_load(path, bits), _cells(anchors, bits)):
        out &= np.isin(cells, hot)
    return out


def divided(values: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, at: np.ndarray, w: Windows):
    """(start, n, anchor) of the runs cut into ``parts``, each with an anchor of its own.

    Equal windows hold their anchor at equal offsets, so a part is a range of
    offsets.  All windows of a part share the items from the farthest left to
    the farthest right that each of them reaches; these name the part's group.
    With a part for each offset that is the whole window.
    """
    span = w.width - w.gram
    bounds = np.linspace(0, span + 1, min(w.parts, span + 1) + 1).astype(np.int64)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:] - 1):  # offsets lo .. hi
        first, last = np.maximum(start, at - hi), np.minimum(start + n - 1, at - lo)
        own = first <= last
        a = at[own]
        with np.errstate(over="ignore"):
            key = textbuf.mix(_span(values, a - lo, a + w.gram + span - hi) + anchor[own] + U64(lo))
        out.append((first[own], (last - first)[own] + 1, key))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _ranks(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Dense ranks of (document, row, start), equal places ranked alike."""
    order = np.lexsort((start, key, doc))
    d, k, s = doc[order], key[order], start[order]
    new = np.ones(len(order), np.int64)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def later(groups: tuple[np.ndarray, ...], rank: np.ndarray) -> np.ndarray:
    """True where a row of the same group has a smaller rank."""
    order = np.lexsort((rank, *groups))
    new = np.ones(len(order), bool)
    new[1:] = False
    for g in groups:
        g = g[order]
        new[1:] |= g[1:] != g[:-1]
    least = rank[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = rank[order] > least
    return out


def expand(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + n[i] - 1, one after the other."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts, n)


def _slice_runs(b, w: Windows, path: str, bits: int):
    """The runs of one slice whose anchor is estimated repeated, with content:
    window hashes (words) or snippets and their hashes (bytes)."""
    values, per, buf = _items(b, w)
    start, n, anchor, at = runs(values, per, w)
    hit = np.flatnonzero(estimated_repeated(anchor, path, bits))
    start, n, anchor, at = start[hit], n[hit], anchor[hit], at[hit]
    hot = estimated_hot(anchor, path, bits)
    if hot.any():
        parts = divided(values, start[hot], n[hot], anchor[hot], at[hot], w)
        start, n, anchor = (np.concatenate([x[~hot], y]) for x, y in zip((start, n, anchor), parts))
    first = np.concatenate([[0], np.cumsum(per)])
    owner = np.searchsorted(first, start, "right") - 1
    doc = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    key = b.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    if w.of_bytes:
        stop = start + n - 1 + w.width
        hashes, blobs = _span(values, start, stop), [buf[i:j].tobytes() for i, j in zip(start, stop)]
    else:
        hashes, blobs = textbuf.rolling(values, w.width, 2)[expand(start, n)] if len(n) else np.empty(0, U64), []
    return doc, key, start - first[owner], n, anchor, hashes, blobs


def _settle(held: list, w: Windows):
    """One batch of candidates: open runs with their data, and for each
    document a row with those that occur earlier in the batch."""
    doc, key, place, n, anchor, hashes = (np.concatenate([h[i] for h in held]) for i in range(6))
    ends = np.cumsum(n)
    if w.of_bytes:
        settled = later((hashes, anchor), _ranks(doc, key, place))
        blobs = [x for h in held for x in h[6]]
    else:
        run_of = np.repeat(np.arange(len(n)), n)
        late = later((hashes, anchor[run_of]), _ranks(doc, key, place)[run_of] * w.width + expand(np.zeros(len(n), np.int64), n))
        settled = np.add.reduceat(late.astype(np.int64), ends - n) == n
    open_ = np.flatnonzero(~settled)
    if w.of_bytes:
        data = [blobs[i] for i in open_.tolist()]
    else:
        data = [hashes[i:j].tobytes() for i, j in zip((ends - n)[open_].tolist(), ends[open_].tolist())]
    yield pa.record_batch([pa.array(anchor[open_].view(np.int64)), pa.array(doc[open_]), pa.array(key[open_]), pa.array(place[open_].astype(np.int32)), pa.array(n[open_].astype(np.int32)), pa.array(data, pa.binary()), pa.nulls(len(open_), pa.binary())], _COLUMNS)
    done = removed_rows(doc[settled], key[settled], place[settled], n[settled])
    if done.num_rows:  # they need no partner: spread them
        spread = textbuf.mix(done.column("doc_id").to_numpy().view(U64)).view(np.int64)
        zero = pa.array(np.zeros(done.num_rows, np.int32))
        yield pa.record_batch([pa.array(spread), done.column("doc_id"), done.column("row_key"), zero, zero, pa.nulls(done.num_rows, pa.binary()), done.column("runs")], _COLUMNS)


def _candidates(w: Windows, path: str, bits: int, hold_bytes: int = 12_000_000):
    def run(batches):
        held, size = [], 0
        for b in textbuf.slices(batches, "text"):
            found = _slice_runs(b, w, path, bits)
            if len(found[0]):
                held.append(found)
                size += 40 * len(found[0]) + found[5].nbytes + sum(map(len, found[6]))
            if size > hold_bytes:
                yield from _settle(held, w)
                held, size = [], 0
        if held:
            yield from _settle(held, w)

    return run


def _span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of values that may overlap."""
    return textbuf.value_spans(values, starts, ends, 2)


def candidates(rows: DataFrame, w: Windows, path: str, bits: int) -> DataFrame:
    """Open runs whose anchor is estimated repeated, with ``data``, and a row
    with packed ``runs`` for each document that has settled ones.

    Rows without an id have no place in the order: they match nothing.
    """
    return rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_candidates(w, path, bits), CANDIDATES)


def removed_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray):
    """One row for each document with its removed runs of windows."""
    order = np.lexsort((start, key, doc))
    doc, key = doc[order], key[order]
    pairs = np.stack([start[order], n[order]], axis=1).astype("<i4")
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.empty(0, np.int64)
    stops = np.append(at[1:], len(doc))
    return pa.record_batch([pa.array(doc[at].astype(np.int64)), pa.array(key[at].astype(np.int64)), pa.array([pairs[i:j].tobytes() for i, j in zip(at, stops)], pa.binary())], ["doc_id", "row_key", "runs"])


def removed_runs(doc: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray):
    """One row for each run: their number doesn't hang on how tasks are dealt."""
    pairs = np.stack([start, n], axis=1).astype("<i4").tobytes()
    offs = np.arange(0, 8 * len(doc) + 1, 8, dtype=np.int32)
    runs_ = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(pairs)])
    return pa.record_batch([pa.array(doc.astype(np.int64)), pa.array(key.astype(np.int64)), runs_], ["doc_id", "row_key", "runs"])


def settled_rows(t: pa.Table) -> pa.RecordBatch:
    """The rows of a table of candidates that are finished."""
    done = t.filter(t.column("runs").is_valid()).select(["doc_id", "row_key", "runs"]).combine_chunks()
    return pa.record_batch([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in done.columns], done.schema.names)


def window_runs(run: np.ndarray, doc, key, start, flagged):
    """Join flagged windows of one run that follow each other.

    Windows of a run stand together and in order; ``run`` numbers them.
    """
    run, doc, key, start = run[flagged], doc[flagged], key[flagged], start[flagged]
    head = np.ones(len(doc), bool)
    head[1:] = (run[1:] != run[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(head)
    stops = np.append(at[1:], len(doc))
    n = start[stops - 1] - start[at] + 1 if len(at) else at
    return doc[at], key[at], start[at], n


def with_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows with ``runs``: all removed runs of windows of a document."""
    per_doc = removed.groupBy("doc_id", "row_key").agg(F.collect_list("runs").alias("runs"))
    return rows.join(per_doc, ["doc_id", "row_key"], "left")


def covered(batch: pa.RecordBatch, per_text: np.ndarray, width: int, column: str = "runs") -> np.ndarray:
    """Which items of a slice are covered by a removed window."""
    total = int(per_text.sum())
    mark = np.zeros(total + 1, np.int64)
    first = np.concatenate([[0], np.cumsum(per_text)])
    parts = batch.column(column)
    buf, offs = textbuf.flat(parts.flatten())
    pairs = np.frombuffer(buf.tobytes(), "<i4").reshape(-1, 2).astype(np.int64)
    ends = offs[np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64))] // 8
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
    np.add.at(mark, first[row] + pairs[:, 0], 1)
    np.add.at(mark, np.minimum(first[row] + pairs[:, 0] + pairs[:, 1] + width - 1, first[row + 1]), -1)
    return np.cumsum(mark)[:total] > 0
