"""Substring dedup over word windows with a count-min prefilter.

Every window of 20 consecutive words whose word sequence also starts earlier
(smaller doc_id, or the same document, earlier start) is removed, judged on
the input.  ``repeats`` describes the prefilter; here the windows of the runs
that pass it are grouped exactly, by the 64-bit hashes of window and anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import repeats, scratch, textbuf
from plantpulse.llm.repeats import HOT


def _resolve(batches):
    """Windows of each anchor's runs that also start earlier.

    A group that exceeds a chunk goes on in the next: of what went before, only
    the earliest place of each window is carried along.
    """
    carry = None
    for t, unfinished in textbuf.group_chunks(batches, "anchor"):
        yield repeats.settled_rows(t)
        t = t.filter(t.column("data").is_valid())
        anchor, doc, key, start, n = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc_id", "row_key", "start", "n"))
        hashes = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint64)
        run = np.repeat(np.arange(len(n)), n)
        windows = [anchor[run], doc[run], key[run], repeats.expand(start, n), hashes, run]
        if carry is not None:  # each window a run of its own
            windows = [np.concatenate([x, y]) for x, y in zip(windows, [*carry, len(n) + np.arange(len(carry[0]))])]
        anchor, doc, key, place, hashes, run = windows
        flagged = repeats.later((hashes, anchor), repeats._ranks(doc, key, place))
        yield repeats.removed_runs(*repeats.window_runs(run, doc, key, place, flagged))
        carry = None
        if unfinished is not None:
            rest = np.flatnonzero(~flagged & (anchor == unfinished))
            rest = rest[np.unique(hashes[rest], return_index=True)[1]]
            carry = [x[rest] for x in windows[:5]]


def repeated_windows(rows: DataFrame, w: repeats.Windows) -> DataFrame:
    """(doc_id, row_key, runs): packed (first word, windows) pairs to remove."""
    path = scratch.root(rows.sparkSession) + "/sketch"
    bits = repeats.sketch(rows, w, path)
    found = repeats.candidates(rows, w, path, bits)
    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve, repeats.REMOVED)


def _apply(width: int):
    def run(batches):
        for b in textbuf.slices(batches, "text"):
            buf, offs = textbuf.flat(b.column("text"))
            ws, we = textbuf.words(buf, offs)
            per = textbuf.counts(ws, offs)
            gone = repeats.covered(b, per, width)
            # every kept word followed by one space, the last of a text without
            keep = ~gone
            first = np.concatenate([[0], np.cumsum(per)])
            ks, length = ws[keep], (we - ws)[keep] + 1
            out = np.full(int(length.sum()), 32, np.uint8)
            at = np.cumsum(length) - length
            src = repeats.expand(ks, length - 1)
            out[repeats.expand(at, length - 1)] = buf[src]
            kept = textbuf.sums(keep, first)
            bounds = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(kept)])]
            raw = out.tobytes()
            texts = [raw[i : j - 1] if j > i else b"" for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("row_key"), pa.array(per.astype(np.int64)), pa.array((per - kept).astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "row_key", "n_words", "n_removed", "kept_text"],
            )

    return run


def _windows(width: int, gram: int, hot: int) -> repeats.Windows:
    """A hot anchor's runs are divided into single windows: they send hashes only."""
    return repeats.Windows(width, gram, False, hot=hot, parts=width)


def substring_dedup(docs: DataFrame, width: int = 20, gram: int = 8, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, row_key, n_words, n_removed, kept_text.

    ``kept_text`` is the kept words joined by one space.  A null or empty text
    has no words; one shorter than a window loses nothing.  Rows without an id
    lose nothing and remove nothing.  Rows equal in id and text stand at one
    place and don't remove each other; rows with one id and different texts
    are ordered by their text's hash (``row_key``).  An empty table gives an
    empty result; other columns are ignored.  Texts of any length are read
    whole.  Anchors of ``hot`` runs or more are divided; results don't depend
    on it.
    """
    rows = repeats.identified(docs, id_col, text_col)
    joined = repeats.with_removed(rows, repeated_windows(rows, _windows(width, gram, hot)))
    return joined.mapInArrow(_apply(width), "doc_id long, row_key long, n_words long, n_removed long, kept_text string")


def _cut(width: int, text_col: str, runs_name: str, names: list[str]):
    def run(batches):
        for b in textbuf.slices(batches, text_col):
            buf, offs = textbuf.flat(b.column(text_col))
            ws, we = textbuf.words(buf, offs)
            per = textbuf.counts(ws, offs)
            gone = np.flatnonzero(repeats.covered(b, per, width, runs_name))
            # a removed word goes with the white space before it
            doc = np.searchsorted(offs, ws, "right") - 1
            before = np.concatenate([[0], we[:-1]]) if len(we) else we
            begin = np.maximum(before, offs[doc])
            mark = np.zeros(len(buf) + 1, np.int32)
            np.add.at(mark, begin[gone], 1)
            np.add.at(mark, we[gone], -1)
            keep = np.cumsum(mark)[:-1] == 0
            at = np.concatenate([[0], np.cumsum(textbuf.sums(keep, offs))]).tolist()
            raw = buf[keep].tobytes()
            hit = b.column(runs_name).is_valid().to_pylist()
            old = b.column(text_col).to_pylist()
            texts = [raw[i:j].decode().strip(" \t\n\v\f\r") if h else t for h, i, j, t in zip(hit, at[:-1], at[1:], old)]
            yield pa.record_batch([pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names], names)

    return run


def without_repeats(docs: DataFrame, width: int = 20, gram: int = 8, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated windows cut out of the text, all columns kept.

    White space between kept words stays; a character count is brought up to
    date.  Texts that lose nothing are unchanged, nulls stay null.  Rows
    without an id lose nothing; rows equal in id and text lose the same.
    Texts of any length are read whole, columns of any name are handed on, and
    an empty table stays empty.
    """
    removed = repeated_windows(repeats.identified(docs, id_col, text_col), _windows(width, gram, hot))
    doc_id, key, runs = scratch.fresh(docs, "removed_id", "removed_key", "runs")
    per_doc = removed.groupBy(F.col("doc_id").alias(doc_id), F.col("row_key").alias(key)).agg(F.collect_list("runs").alias(runs))
    met = (F.col(id_col).cast("long") == F.col(doc_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(key))
    out = docs.join(per_doc, met, "left").select(*docs.columns, runs).mapInArrow(_cut(width, text_col, runs, docs.columns), docs.schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))
