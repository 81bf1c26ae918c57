"""Quality rules with cross-document line frequency.

Lines are normalised (words, A-Z lower-cased, one space between) and hashed.
For every host the distinct documents that hold a line are counted; documents
with the same text count once, so that a page stored many times does not turn
its own prose into boilerplate.  Lines above the limit are removed, and a
document is rejected if removal leaves too little of it.

The line table is one row for each distinct line of a document.  Counting is a
two-step aggregate (distinct, then count) with map-side combining, so a line
that a third of all documents hold costs one row for each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf


@dataclass(frozen=True)
class LineLimits:
    """A line goes if more than ``min_documents`` documents of its host hold
    it and they are more than ``max_share`` of the host's distinct documents.
    A document is depleted if less than ``min_left`` of its words stay."""

    min_documents: int = 20
    max_share: float = 0.02
    min_left: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


#: Copies of each frequent line in the join with the texts' lines.
COPIES = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _repeat_words(hashes, per_text, k=3):
    """Words of each text inside a window of k that the text has twice or more."""
    out = np.zeros(len(per_text), np.int64)
    grams = textbuf.rolling(hashes, k)
    ok = np.flatnonzero(textbuf.inside(per_text, k))
    if len(ok) == 0:
        return out
    own = textbuf.owner(per_text)
    bits = np.uint64(max(1, int(len(per_text) - 1).bit_length()))
    keyed = (own[ok].astype(np.uint64) << (np.uint64(64) - bits)) | (grams[ok] >> bits)
    order = np.argsort(keyed)
    ranked = keyed[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = textbuf.cover(ok[order[twice]], k, len(hashes))
    np.add.at(out, own[hit], 1)
    return out


def _first_in_group(group, key):
    """True for the first row of each (group, key), in row order."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    first = np.ones(len(order), bool)
    first[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    out = np.zeros(len(order), bool)
    out[order] = first
    return out


def _lines(buf, offs, ws):
    """Starts, ends, first word, past last word and text of the lines: runs
    without a newline; those without a word don't count."""
    ls, le = textbuf.runs(buf != 10, offs)
    first_word, past_word = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    has = past_word > first_word
    ls, le, first_word, past_word = ls[has], le[has], first_word[has], past_word[has]
    return ls, le, first_word, past_word, np.searchsorted(offs, ls, "right") - 1


def _stats(batches):
    for b in textbuf.slices(batches, "text"):
        buf, offs = textbuf.flat(b.column("text"))
        n = b.num_rows
        ws, we = textbuf.words(buf, offs)
        per = textbuf.counts(ws, offs)
        exact = textbuf.span_hashes(buf, ws, we)
        lower = textbuf.span_hashes(textbuf.lower_ascii(buf), ws, we)
        in_word = ~textbuf._SEP[buf]
        ls, le, first_word, past_word, line_doc = _lines(buf, offs, ws)
        raw = textbuf.span_hashes(buf, ls, le)
        dup = ~_first_in_group(line_doc, raw)
        norm = textbuf.value_spans(lower, first_word, past_word)
        # one row for each distinct normalised line, with the words it has in all its places
        order = np.lexsort((norm, line_doc))
        g, k, w = line_doc[order], norm[order], (past_word - first_word)[order]
        head = np.ones(len(order), bool)
        head[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(head)
        words_of = np.add.reduceat(w, at) if len(at) else np.empty(0, np.int64)
        per_lines = np.bincount(g[at], minlength=n)
        full = offs[1:] > offs[:-1]
        text_key = np.zeros(n, np.uint64)
        text_key[full] = textbuf.span_hashes(buf, offs[:-1][full], offs[1:][full])
        yield pa.record_batch(
            [
                b.column("doc_id"), b.column("host"), pa.array(text_key.view(np.int64)), pa.array(per.astype(np.int64)),
                pa.array(textbuf.sums(in_word & ((buf & 0xC0) != 0x80), offs)), pa.array(textbuf.sums(_SYMBOL[buf], offs)),
                pa.array(np.bincount(line_doc[dup], minlength=n).astype(np.int64)), pa.array(_repeat_words(exact, per)),
                textbuf.lists(per_lines, pa.array(k[at].view(np.int64))), textbuf.lists(per_lines, pa.array(words_of.astype(np.int32))),
            ],
            ["doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
        )


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base counts of every document and its distinct lines.

    A null or empty text has no words and zero counts.  A null host is a host
    of its own.  Other columns of the input, whatever their names, are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _host(host_col).alias("host"))
    return picked.mapInArrow(_stats, STATS)


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def frequent_lines(stats: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, line, n_docs) of the lines above the limits."""
    held = stats.select("host", "text_key", F.explode("lines").alias("line")).distinct()
    counted = held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limits.min_documents)
    sizes = stats.select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counted.join(sizes, "host").filter(F.col("n_docs") > F.col("host_docs") * limits.max_share).select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: base counts, verdicts and what line removal takes.

    ``base_failed``: under ``min_words`` words, or more than
    ``max_repeat_percent`` % of the words in repeated 3-word windows.
    ``n_removed_words``: words on lines above the limits.  ``kept``: not
    base_failed and not depleted.  An empty table gives an empty result; rows
    that repeat an id are judged one by one, and equal texts alike.
    """
    stats, removed = _removed_words(docs, limits, id_col, text_col, host_col)
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        stats.drop("lines", "line_words")
        .join(removed.drop("removed_lines"), ["host", "text_key"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", _base_failed(limits))
        .withColumn("kept", ~F.col("base_failed") & (left >= limits.min_left * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
    )


def _base_failed(limits: LineLimits):
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def _removed_words(docs, limits, id_col, text_col, host_col) -> tuple[DataFrame, DataFrame]:
    """Document stats, and for each text of a host its frequent lines and the words on them."""
    stats = scratch.stored(document_stats(docs, id_col, text_col, host_col), scratch.root(docs.sparkSession) + "/stats")
    frequent = frequent_lines(stats, limits)
    # Equal texts of a host get one verdict, so their lines are joined once.
    texts = stats.groupBy("host", "text_key").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    lines = texts.select("host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "text_key", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
    # A line of very many texts is one key: texts are dealt over several copies of it.
    copies = frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("dealt"))
    removed = lines.withColumn("dealt", F.pmod("text_key", F.lit(COPIES)).cast("int")).join(copies, ["host", "line", "dealt"], "left_semi").groupBy("host", "text_key").agg(F.sum("w").cast("long").alias("n_removed_words"), F.collect_list("line").alias("removed_lines"))
    return stats, removed


def _passed(b, limits: LineLimits, text_col: str) -> pa.Array:
    """Which rows of a slice pass the base rules."""
    n = b.num_rows
    source = pa.record_batch([pa.nulls(n, pa.int64()), b.column(text_col).cast(pa.string()), pa.nulls(n, pa.string())], ["doc_id", "text", "host"])
    parts = list(_stats([source]))
    words, repeats = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("n_words", "n_repeat_words"))
    return pa.array((words >= limits.min_words) & (100 * repeats <= limits.max_repeat_percent * words))


def _kept_rows(limits: LineLimits, text_col: str, chars_col: str, lines_name: str, names: list[str]):
    """Rows that pass the base rules, without the lines whose hashes are in the column ``lines_name``."""

    def run(batches):
        for b in textbuf.slices(batches, text_col):
            b = b.filter(_passed(b, limits, text_col))
            lists = b.column(lines_name)
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            columns = {c: b.column(c) for c in names}
            if len(hit):
                buf, offs = textbuf.flat(b.column(text_col))
                ws, we = textbuf.words(buf, offs)
                ls, le, first_word, past_word, line_doc = _lines(buf, offs, ws)
                norm = textbuf.value_spans(textbuf.span_hashes(textbuf.lower_ascii(buf), ws, we), first_word, past_word).view(np.int64)
                of = np.searchsorted(line_doc, np.arange(b.num_rows + 1))
                mark = np.zeros(len(buf) + 1, np.int32)
                for i in hit.tolist():
                    at = of[i] + np.flatnonzero(np.isin(norm[of[i] : of[i + 1]], lists[i].values.to_numpy()))
                    mark[ls[at]] += 1
                    np.add.at(mark, np.minimum(le[at] + 1, offs[i + 1]), -1)
                keep = np.cumsum(mark)[:-1] == 0
                ends = np.concatenate([[0], np.cumsum(textbuf.sums(keep, offs))]).tolist()
                raw, texts = buf[keep].tobytes(), b.column(text_col).to_pylist()
                for i in hit.tolist():
                    texts[i] = raw[ends[i] : ends[i + 1]].decode()
                columns[text_col] = pa.array(texts, pa.string())
                if chars_col in columns:
                    old = columns[chars_col]
                    columns[chars_col] = pc.if_else(lists.is_valid(), pc.utf8_length(columns[text_col]).cast(old.type), old)
            yield pa.record_batch(list(columns.values()), names)

    return run


def passing(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns
    and without the lines above the limits.

    A removed line goes with the newline after it; all else of a text stays,
    and a character count is brought up to date.  Texts meet the hashes of
    their frequent lines; base rules need no other document and are applied
    where lines are cut.  Null and empty texts have no words and go; rows
    without an id or host are judged like others; equal rows are judged alike.
    Texts of any length are read whole, columns of any name are handed on, and
    an empty table stays empty.
    """
    row_key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Spark's own hash of a text stands where stats have an id: rows meet their
    # verdict without a Python step before the one that cuts.
    keyed = docs.select(row_key.alias("doc_id"), F.col(text_col).alias("text"), _host(host_col).alias("host"))
    stats, removed = _removed_words(keyed, limits, "doc_id", "text", "host")
    sizes = stats.filter(~_base_failed(limits)).select("host", "text_key", "doc_id", "n_words").distinct()
    left = F.col("n_words") - F.col("n_removed_words")
    host, key, lines, depleted = scratch.fresh(docs, "host", "key", "lines", "depleted")
    judged = removed.join(sizes, ["host", "text_key"]).select(F.col("host").alias(host), F.col("doc_id").alias(key), F.col("removed_lines").alias(lines), (left < limits.min_left * F.col("n_words")).alias(depleted))
    judged = scratch.stored(judged, scratch.root(docs.sparkSession) + "/judged")
    met = docs.join(judged, (_host(host_col) == F.col(host)) & (row_key == F.col(key)), "left").filter(~F.coalesce(F.col(depleted), F.lit(False)))
    return met.select(*docs.columns, lines).mapInArrow(_kept_rows(limits, text_col, chars_col, lines, docs.columns), docs.schema)
