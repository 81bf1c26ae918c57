"""Quality of texts by a factorisation machine.

A text's features are its hashed words (lower-cased, logarithmic counts of unit
length), statistics of its structure in bins, and bins of numeric metadata.  The
machine scores single features and all pairs of them, a pair by the product of
two short vectors.  The sum over pairs is half of (the square of the sum minus
the sum of squares) in every dimension, so a score costs no more than a few
passes over the features a text has.

Scoring is one pass over the table without a shuffle.  Fitting takes a bounded
sample of labelled rows (``Fit.rows``, the least by a hash of the id) to the
driver, as numbers: at most ``BUCKETS`` and the bins of a row, some 200 MB
if every text held all buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import textbuf
from plantpulse.llm.quality_rules import _first_in_group, _lines, _repeat_words


@dataclass(frozen=True)
class Fit:
    """``rows`` bounds the labelled sample; ``factors`` is the length of the
    vectors; the rest steers the descent."""

    rows: int = 8192
    factors: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.1
    penalty: float = 1e-5
    seed: int = 11


#: Buckets of hashed words, as a power of two.
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SIZES = np.exp2(np.arange(1, 17))
LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24])
#: Statistics of structure and the edges of their bins.
STATS = {
    "symbols": SHARES, "capitals": SHARES, "digits": SHARES, "beyond_ascii": SHARES, "stops": SHARES, "exclamations": SHARES, "bare_words": SHARES,
    "distinct_words": SHARES, "repeated_words": SHARES, "repeated_lines": SHARES, "word_length": LENGTHS, "line_words": SIZES, "words": SIZES,
}


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _STOP, _DIGIT, _BANG = (_members(c) for c in (b"#*$%&|<>", b".,;:!?", b"0123456789", b"!"))
_UPPER, _LOWER = _members(bytes(range(0x41, 0x5B))), _members(bytes(range(0x61, 0x7B)))
_WORDY = _UPPER | _LOWER | _DIGIT | _members(bytes(range(0x80, 0x100)))


def width(metadata: int) -> int:
    """Features in all: buckets, bins of statistics, bins and a missing mark of metadata."""
    return BUCKETS + sum(len(e) + 1 for e in STATS.values()) + metadata * (len(SIZES) + 2)


def statistics(buf, offs, ws, we, per, hashes) -> dict[str, np.ndarray]:
    """The structure of every text; a share of nothing is 0."""
    count = lambda m: textbuf.sums(m[buf], offs)
    over = lambda a, b: a / np.maximum(b, 1)
    size, n = np.diff(offs), len(per)
    own = textbuf.owner(per)
    first = _first_in_group(own, hashes) if len(hashes) else np.empty(0, bool)
    wordy = np.concatenate([[0], np.cumsum(_WORDY[buf])])
    bare = wordy[we] == wordy[ws]
    ls, le, _, _, line_doc = _lines(buf, offs, ws)
    lines = np.bincount(line_doc, minlength=n)
    again = ~_first_in_group(line_doc, textbuf.span_hashes(buf, ls, le)) if len(ls) else np.empty(0, bool)
    of = lambda m, who: np.bincount(who[m], minlength=n)
    return {
        "symbols": over(count(_SYMBOL), size), "capitals": over(count(_UPPER), count(_UPPER) + count(_LOWER)), "digits": over(count(_DIGIT), size), "beyond_ascii": over(textbuf.sums(buf >= 0x80, offs), size),
        "stops": over(count(_STOP), size), "exclamations": over(count(_BANG), size), "bare_words": over(of(bare, own), per), "distinct_words": over(of(first, own), per), "repeated_words": over(_repeat_words(hashes, per), per),
        "repeated_lines": over(of(again, line_doc), lines), "word_length": over(np.add.reduceat(np.append(we - ws, 0), np.minimum(np.cumsum(per) - per, len(ws))) * (per > 0), per), "line_words": over(per, lines), "words": per.astype(float),
    }


def examples(texts, metadata: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each text, their numbers, their values), text after text."""
    buf, offs = textbuf.flat(texts)
    n = len(offs) - 1
    ws, we = textbuf.words(buf, offs)
    per = textbuf.counts(ws, offs)
    hashes = textbuf.span_hashes(textbuf.lower_ascii(buf), ws, we)
    key, times = np.unique((textbuf.owner(per).astype(np.int64) << BUCKET_BITS) | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    who, value = key >> BUCKET_BITS, np.log1p(times)
    length = np.sqrt(np.bincount(who, value * value, minlength=n))
    bins, at = [], BUCKETS
    for name, x in statistics(buf, offs, ws, we, per, hashes).items():
        bins.append(at + np.searchsorted(STATS[name], x, "left"))
        at += len(STATS[name]) + 1
    for x in metadata:
        x = np.asarray(x, float)
        bins.append(at + np.where(np.isnan(x), len(SIZES) + 1, np.searchsorted(SIZES, np.nan_to_num(x), "left")))
        at += len(SIZES) + 2
    rows = np.concatenate([who, np.tile(np.arange(n), len(bins))])
    feature = np.concatenate([key & (BUCKETS - 1), *bins]).astype(np.int64)
    values = np.concatenate([value / length[who], np.ones(n * len(bins))])
    order = np.argsort(rows, kind="stable")
    return np.bincount(rows, minlength=n), feature[order], values[order]


@dataclass
class Machine:
    """Bias, weight of each feature, and vector of each feature."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, per: np.ndarray, feature: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before squashing, and the sums of vectors; every row has features."""
        begin = np.cumsum(per) - per
        moved = self.vectors[feature] * values[:, None]
        total = np.add.reduceat(moved, begin)
        pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((moved * moved).sum(1), begin))
        return self.bias + np.add.reduceat(self.weights[feature] * values, begin) + pairs, total

    def scores(self, per, feature, values) -> np.ndarray:
        """Between 0 and 1; 9 places, so that equal texts get equal scores anywhere."""
        return np.round(_squash(self.raw(per, feature, values)[0]), 9)

    def slopes(self, per, feature, values, truth) -> tuple[float, np.ndarray, np.ndarray]:
        """Of the mean logarithmic loss, by bias, weights and vectors."""
        raw, total = self.raw(per, feature, values)
        blame = (_squash(raw) - truth) / len(truth)
        each = np.repeat(blame, per) * values
        size, factors = self.vectors.shape
        towards = np.repeat(total, per, 0) - self.vectors[feature] * values[:, None]
        return float(blame.sum()), np.bincount(feature, each, minlength=size), np.stack([np.bincount(feature, each * towards[:, f], minlength=size) for f in range(factors)], 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(per: np.ndarray, feature: np.ndarray, values: np.ndarray, truth: np.ndarray, size: int, fit: Fit = Fit()) -> Machine:
    """Descent with a step of its own for every number (by past slopes)."""
    rng = np.random.default_rng(fit.seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, fit.factors)))
    seen = [1e-8, np.full(size, 1e-8), np.full(m.vectors.shape, 1e-8)]
    ends = np.cumsum(per)
    for _ in range(fit.epochs if len(per) else 0):
        order = rng.permutation(len(per))
        for lo in range(0, len(order), fit.batch):
            rows = order[lo : lo + fit.batch]
            n = per[rows]
            at = np.arange(n.sum()) + np.repeat(ends[rows] - n - (np.cumsum(n) - n), n)
            slopes = m.slopes(n, feature[at], values[at], truth[rows])
            slopes = [slopes[0], slopes[1] + fit.penalty * m.weights, slopes[2] + fit.penalty * m.vectors]
            seen = [s + g * g for s, g in zip(seen, slopes)]
            steps = [fit.rate * g / np.sqrt(s) for s, g in zip(seen, slopes)]
            m.bias, m.weights, m.vectors = m.bias - float(steps[0]), m.weights - steps[1], m.vectors - steps[2]
    return m


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from: a third, by a checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _picked(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)])


def _example_rows(k: int):
    def run(batches):
        for b in textbuf.slices(batches, "text"):
            per, feature, values = examples(b.column("text"), _metadata(b, k))
            yield pa.record_batch([b.column("doc_id"), b.column("truth"), textbuf.lists(per, pa.array(feature.astype(np.int32))), textbuf.lists(per, pa.array(values.astype(np.float32)))], ["doc_id", "truth", "feature", "value"])

    return run


def _metadata(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [b.column(f"meta{i}").to_numpy(zero_copy_only=False) for i in range(k)]


def sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, metadata: tuple[str, ...], label_col: str) -> DataFrame:
    """At most ``rows`` labelled rows that aren't held out, with their features.

    An id with labels of both kinds teaches nothing; of an id with several
    texts one counts, the least by a hash.
    """
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("truth")).filter(F.col("doc_id").isNotNull() & F.col("truth").isin(0, 1) & ~held_out("doc_id"))
    told = told.groupBy("doc_id").agg(F.min("truth").alias("truth"), F.max("truth").alias("most")).filter("truth = most")
    few = told.select("doc_id", "truth").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = _picked(docs, id_col, text_col, metadata).join(F.broadcast(few), "doc_id")  # at most ``rows`` rows
    names = [c for c in found.columns if c not in ("doc_id", "truth")]
    once = found.groupBy("doc_id", "truth").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r")).select("doc_id", "truth", "r.*")
    return once.mapInArrow(_example_rows(len(metadata)), "doc_id long, truth int, feature array<int>, value array<float>")


def fit_machine(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), label_col: str = "quality") -> Machine:
    """The machine fitted on the labelled sample; without any it scores 0.5."""
    taught = sample(docs, labels, fit.rows, id_col, text_col, metadata, label_col).toArrow().combine_chunks().sort_by("doc_id")
    flat = lambda c: np.concatenate([x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in taught.column(c).chunks] or [np.empty(0)])
    per = taught.column("feature").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if taught.num_rows else np.empty(0, np.int64)
    if len(per) == 0:
        return Machine(0.0, np.zeros(width(len(metadata))), np.zeros((width(len(metadata)), fit.factors)))
    return train(per, flat("feature").astype(np.int64), flat("value").astype(float), taught.column("truth").to_numpy().astype(float), width(len(metadata)), fit)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of every row, by a fitted machine."""
    small = Machine(machine.bias, machine.weights, machine.vectors)

    def run(batches):
        for b in textbuf.slices(batches, "text"):
            found = examples(b.column("text"), _metadata(b, len(metadata)))
            yield pa.record_batch([b.column("doc_id"), pa.array(small.scores(*found))], ["doc_id", "score"])

    return _picked(docs, id_col, text_col, metadata).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",), label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5) of every row.

    ``metadata`` names numeric columns of ``docs``; the id, the label and
    categories such as a source are no inputs.  Null and empty texts are scored
    by their structure (no words) and metadata, null metadata by a mark of its own.  Texts of any length are read whole;
    repeated rows get equal scores; rows without an id are never learnt from and
    count as not held out.  Null and odd labels are ignored, without labels all
    scores are 0.5; an empty table gives an empty result, other columns are ignored.
    """
    machine = fit_machine(docs, labels, fit, id_col, text_col, metadata, label_col)
    scored = score(docs, machine, id_col, text_col, metadata)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
