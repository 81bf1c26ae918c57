"""Exact byte-string dedup with suffix arrays of shards.

Every byte covered by a 100-byte string that also starts earlier (smaller
doc_id, or the same document, earlier start) is removed, judged on the input.
``repeats`` cuts documents into runs of windows under content-chosen anchors
and keeps runs whose anchor may be repeated.  Equal strings have equal anchors,
so shards of whole anchors see every pair of equal strings.  A shard joins its
distinct snippets into one text, builds its suffix array by induced sorting
and its permuted common prefixes; neighbours in suffix order that share 100
bytes form a group, and all of a group's strings but the earliest go.
A snippet stored many times is one snippet with its earliest place, so a hot
passage costs its length once, and an anchor with one distinct snippet has no
other to be sorted against.  An anchor that very many snippets share is divided
by the bytes around it (``repeats.divided``), so that no shard holds them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantpulse.llm import repeats, scratch, textbuf
from plantpulse.llm.repeats import HOT
from plantpulse.llm.suffix_array import permuted_lcp, suffix_array

#: Bytes of snippets in one suffix array; a shard of more takes several turns.
SHARD_BYTES = 1_000_000


def _groups(text: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """A group number for each window of the snippets, equal for equal strings.

    ``text``: the snippets, each followed by a 1, then a final 0; a snippet's
    windows start at ``first`` and the next ``n`` - 1 positions.
    """
    sa = suffix_array(text, 258)
    plcp = permuted_lcp(text, sa)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(plcp[sa] < width)
    return group[repeats.expand(first, n)]


def _shard(anchor, doc, key, start, n, blobs: list[bytes], width: int):
    """The runs of a shard's windows that also start earlier: (doc, key, start, n).

    Rows equal in place are rows of one document: what is said of one holds
    for all.
    """
    snippets: dict[bytes, int] = {}
    which = np.array([snippets.setdefault(x, len(snippets)) for x in blobs])
    place = repeats._ranks(doc, key, start)
    earliest = np.full(len(snippets), np.iinfo(np.int64).max)
    np.minimum.at(earliest, which, place)
    copy = place > earliest[which]
    at = np.full(len(snippets), -1)
    at[which[~copy]] = np.flatnonzero(~copy)  # a row that stands at the earliest place
    _, number, several = np.unique(anchor[at], return_inverse=True, return_counts=True)
    sorted_ = several[number] > 1
    copies = (doc[copy], key[copy], start[copy], n[copy])
    if not sorted_.any():
        return copies
    at = at[sorted_]
    chosen = [x for x, s in zip(snippets, sorted_.tolist()) if s]
    sizes = np.array([len(x) for x in chosen], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"".join(chosen), np.uint8).astype(np.int64) + 2
    text = np.ones(int((sizes + 1).sum()) + 1, np.int64)
    text[repeats.expand(first, sizes)] = joined
    text[-1] = 0
    group = _groups(text, first, n[at], width)
    run = np.repeat(at, n[at])
    where = repeats.expand(start[at], n[at])
    late = repeats.later((group,), repeats._ranks(doc[run], key[run], where))
    found = repeats.window_runs(run, doc[run], key[run], where, late)
    return tuple(np.concatenate(x) for x in zip(copies, found))


def _resolve(width: int):
    def run(batches):
        for t in textbuf.whole_groups(batches, "anchor", SHARD_BYTES):
            yield repeats.settled_rows(t)
            t = t.filter(t.column("data").is_valid())
            if t.num_rows:
                anchor, doc, key, start, n = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "row_key", "start", "n"))
                yield repeats.removed_runs(*_shard(anchor, doc, key, start, n, t.column("data").to_pylist(), width))

    return run


def repeated_strings(rows: DataFrame, w: repeats.Windows) -> DataFrame:
    """(doc_id, row_key, runs): packed (first byte, windows) pairs to remove."""
    path = scratch.root(rows.sparkSession) + "/sketch"
    bits = repeats.sketch(rows, w, path)
    found = repeats.candidates(rows, w, path, bits)
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve(w.width), repeats.REMOVED)


def _apply(width: int):
    def run(batches):
        for b in textbuf.slices(batches, "text"):
            buf, offs = textbuf.flat(b.column("text"))
            gone = repeats.covered(b, np.diff(offs), width)
            starts, _ = textbuf.runs(gone, offs)
            removed = textbuf.sums(gone, offs)
            kept = buf[~gone].tobytes()
            bounds = np.concatenate([[0], np.cumsum(np.diff(offs) - removed)]).tolist()
            parts = [kept[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("row_key"), pa.array(np.diff(offs)), pa.array(removed), pa.array(textbuf.counts(starts, offs).astype(np.int64)), pa.array(parts, pa.binary()), pa.array([hashlib.sha256(p).hexdigest() for p in parts])],
                ["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = 16, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_key, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A null text is empty; texts under ``width`` bytes lose nothing.  Rows
    without an id lose nothing and remove nothing.  Rows equal in id and text
    stand at one place and don't remove each other; rows with one id and
    different texts are ordered by their text's hash (``row_key``).  An empty
    table gives an empty result; other columns are ignored.  Texts of any
    length are read whole.  Anchors of ``hot`` runs or more are divided;
    results don't depend on it.
    """
    rows = repeats.identified(docs, id_col, text_col)
    joined = repeats.with_removed(rows, repeated_strings(rows, repeats.Windows(width, gram, True, hot=hot)))
    return joined.mapInArrow(_apply(width), "doc_id long, row_key long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
