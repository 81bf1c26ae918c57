"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed word n-grams.  A bucket's gain
is the log ratio of its smoothed shares; a document's weight is the floored
mean of its features' gains.  With a Gumbel noise that follows from the id, the
highest scores are a draw without replacement in proportion to the weights.

* **Weights** are array passes over Arrow buffers: checksums of all words of a
  slice at once, gains by one gather, sums by one running total.
* **The cutoff** comes from a mergeable quantile sketch: it brackets the wanted
  rank, exact counts outside the bracket validate it or call for a wider one,
  and only the bracket is sorted to find the last row drawn.
* **Ranks** come from a range partitioning: a row's rank is its place in its
  partition and the sizes of the partitions before it, so no task and not the
  driver ever holds all drawn rows.  The driver sees the buckets' counts.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf


@dataclass(frozen=True)
class Draw:
    """``percent`` of the documents with ``min_words`` words are drawn; features
    are runs of one and two words, hashed to ``buckets``; ``seed`` starts the
    text whose digest is the noise of a document."""

    percent: int = 25
    min_words: int = 20
    buckets: int = 10_000
    seed: str = "7"


#: Words: digits, a-z and all that isn't ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a word that are summed side by side; longer words go one by one.
SHORT = 48
#: How far around the wanted rank the sketch is asked, as shares of the rows;
#: the least and the greatest score come after the last.
MARGINS = (0.001, 0.01, 0.1)
#: The sketch's ranks are wrong by no more than a share of 1 / ACCURACY.
ACCURACY = 10_000


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def crc_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The crc32 of each byte span, carried on from the sums ``before``."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, ranked = starts[order], -size[order]
    out = np.zeros(len(starts), np.uint32) if before is None else before[order]
    long = int(np.searchsorted(ranked, -SHORT, "left"))
    for i in range(long):
        out[i] = zlib.crc32(buf[at[i] : at[i] - ranked[i]].tobytes(), int(out[i]))
    state = out[long:] ^ _ONES
    at, ranked = at[long:], ranked[long:]
    for j in range(int(-ranked[0]) if len(ranked) else 0):
        n = int(np.searchsorted(ranked, -j, "left"))
        state[:n] = _CRC[(state[:n] ^ buf[at[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out[long:] = state ^ _ONES
    back = np.empty_like(out)
    back[order] = out
    return back


_SPACE = np.full(1, 0x20, np.uint8)


def features(texts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each word, bucket of each pair of a word
    and its next, whether the pair lies in one text) of an Arrow array."""
    buf, offs = textbuf.flat(texts)
    buf = textbuf.lower_ascii(buf)
    ws, we = textbuf.runs(_WORD[buf], offs)
    per = textbuf.counts(ws, offs)
    one = crc_spans(buf, ws, we)
    spaced = crc_spans(_SPACE, np.zeros(max(len(ws) - 1, 0), np.int64), np.ones(max(len(ws) - 1, 0), np.int64), one[:-1])
    two = crc_spans(buf, ws[1:], we[1:], spaced)
    return per, (one % np.uint32(buckets)).astype(np.int64), (two % np.uint32(buckets)).astype(np.int64), textbuf.inside(per, 2)


def bucket_counts(texts: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts; one row a bucket and task moves."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in textbuf.slices(batches, "text"):
            _, one, two, inside = features(b.column("text"), buckets)
            total += np.bincount(one, minlength=buckets)
            total += np.bincount(two[inside], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    picked = texts.select(F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of every bucket; the driver gets a row a bucket and table."""
    both = bucket_counts(docs, buckets, text_col).withColumn("which", F.lit(0)).unionByName(bucket_counts(target, buckets, target_col).withColumn("which", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for r in both.collect():
        counts[r["which"], r["bucket"]] = r["n"]
    s, t = counts
    big_s, big_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * big_s) / (float(a + 1) * big_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row; no words: zeros."""

    def run(batches):
        for b in textbuf.slices(batches, "text"):
            per, one, two, inside = features(b.column("text"), len(gains))
            pairs = np.append(np.where(inside, gains[two], 0), 0)[: len(one)]
            total = np.concatenate([[0], np.cumsum(gains[one] + pairs)])
            ends = np.cumsum(per)
            n = np.maximum(2 * per - 1, 0)
            weight = (total[ends] - total[ends - per]) // np.maximum(n, 1)
            yield pa.record_batch([b.column("doc_id"), pa.array(per.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: str = "doc_id"):
    """A Gumbel noise in thousandths that follows from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def bracket(scored: DataFrame, wanted: int, rows: int, margins: tuple[float, ...] = MARGINS) -> tuple[int, int, int]:
    """(low, high, rows above high): the wanted-th greatest score lies within.

    The sketch proposes, exact counts decide: a bracket holds when fewer than
    ``wanted`` scores lie above it and at least ``wanted`` don't lie below.
    """
    middle = 1 - wanted / rows
    asked = [min(max(middle + m, 0.0), 1.0) for margin in (*margins, 1.0) for m in (-margin, margin)]
    sketch = scored.agg(F.percentile_approx("score", F.array(*map(F.lit, asked)), ACCURACY).alias("q"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    for low, high in [*zip(sketch["q"][::2], sketch["q"][1::2]), (sketch["lo"], sketch["hi"])]:
        outside = scored.agg(F.count_if(F.col("score") > high).alias("above"), F.count_if(F.col("score") >= low).alias("reached")).first()
        if outside["above"] < wanted <= outside["reached"]:
            return low, high, outside["above"]
    raise AssertionError("the least and the greatest score hold every rank")


def ranked(rows: DataFrame, path: str, first: int = 1) -> DataFrame:
    """``rank`` by score, then id, from ``first``; equal rows by their number."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("row").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.stored(placed, path).withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    # a row a partition of the sort above, whatever the rows
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at") + first).drop("part", "at", "before", "place")


def resample(docs: DataFrame, target: DataFrame, options: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row.

    Null and empty texts have no features, weight 0, and are never drawn.  Rows
    without an id take the noise of the empty text and come last among equal
    scores; repeated rows are drawn each for itself.  Very long texts are read
    whole.  Other columns are ignored.  An empty table gives an empty result,
    an empty target smooths to equal shares.
    """
    spark, path = docs.sparkSession, scratch.root(docs.sparkSession)
    gains = bucket_gains(docs, target, options.buckets, text_col, target_col)
    scored = weights(docs, gains, id_col, text_col).withColumns({"score": F.col("weight") + noise(options.seed), "eligible": F.col("n_words") >= options.min_words, "row": F.monotonically_increasing_id()}).drop("n_words")
    scored = scratch.stored(scored, f"{path}/scored")
    able = scored.filter("eligible")
    rows = able.count()
    wanted = options.percent * rows // 100
    none = F.lit(None).cast("long").alias("rank")
    shown = ["doc_id", "n_features", "weight", "score"]
    if wanted == 0:
        return scored.select(*shown, none)
    low, high, above = bracket(able, wanted, rows)
    top = ranked(able.filter(F.col("score") > high), f"{path}/above")
    edge = ranked(able.filter(F.col("score").between(low, high)), f"{path}/bracket", above + 1)
    edge = edge.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.filter(~F.col("eligible") | (F.col("score") < low)).select(*shown, none)
    return top.select(*shown, "rank").unionByName(edge.select(*shown, "rank")).unionByName(rest)
