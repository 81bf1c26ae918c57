import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plantpulse.llm import entries
from plantpulse.llm import quality_classifier as quality


def random_machine(size=40, factors=3, seed=1):
    rng = np.random.default_rng(seed)
    return quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, factors)))


def random_rows(n=6, size=40, seed=2):
    rng = np.random.default_rng(seed)
    per = rng.integers(1, 8, n)
    return per, np.concatenate([rng.choice(size, k, replace=False) for k in per]), rng.normal(size=per.sum())


def test_the_sum_of_squares_identity():
    """Scores equal the sum over all pairs of features."""
    m, (per, feature, values) = random_machine(), random_rows()
    at, got = 0, m.raw(per, feature, values)[0]
    for i, n in enumerate(per):
        f, x = feature[at : at + n], values[at : at + n]
        pairs = sum(m.vectors[f[a]] @ m.vectors[f[b]] * x[a] * x[b] for a, b in itertools.combinations(range(n), 2))
        assert got[i] == pytest.approx(m.bias + m.weights[f] @ x + pairs)
        at += n


def test_slopes_are_those_of_the_loss():
    m, rows = random_machine(), random_rows()
    truth = np.array([0, 1, 1, 0, 1, 0.0])

    def loss(machine):
        p = quality._squash(machine.raw(*rows)[0])
        return -np.mean(truth * np.log(p) + (1 - truth) * np.log(1 - p))

    bias, weights, vectors = m.slopes(*rows, truth)
    step, moved = 1e-6, lambda **c: quality.Machine(**{"bias": m.bias, "weights": m.weights, "vectors": m.vectors} | c)
    assert bias == pytest.approx((loss(moved(bias=m.bias + step)) - loss(moved(bias=m.bias - step))) / (2 * step), abs=1e-6)
    for i in rows[1][:8]:
        up, down = m.weights.copy(), m.weights.copy()
        up[i], down[i] = up[i] + step, down[i] - step
        assert weights[i] == pytest.approx((loss(moved(weights=up)) - loss(moved(weights=down))) / (2 * step), abs=1e-6)
        up, down = m.vectors.copy(), m.vectors.copy()
        up[i, 1], down[i, 1] = up[i, 1] + step, down[i, 1] - step
        assert vectors[i, 1] == pytest.approx((loss(moved(vectors=up)) - loss(moved(vectors=down))) / (2 * step), abs=1e-6)


def test_a_machine_learns_a_pair_that_no_single_feature_tells():
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(2)) for _ in range(800)]
    per, feature = np.full(800, 2), np.array([x for a, b in rows for x in (a, 2 + b)])
    truth = np.array([float(a == b) for a, b in rows])
    m = quality.train(per, feature, np.ones(1600), truth, 4, quality.Fit(epochs=40))
    assert (m.scores(per, feature, np.ones(1600)).round() == truth).all()


def test_statistics_of_structure(texts):
    """Each against a count of its own."""
    picked = [t for d, t in texts if t and d not in (6, 72)] + ["A|B || c\nA|B || c\n\nx1 !!", " \n"]
    arr = pa.array([None, *picked])
    per, feature, values = quality.examples(arr, [[float("nan")] + [3.0] * len(picked)])
    ends = np.cumsum(per)
    edges = {}
    at = quality.BUCKETS
    for name, e in quality.STATS.items():
        edges[name], at = (at, e), at + len(e) + 1
    for i, t in enumerate([""] + picked):
        f = feature[ends[i] - per[i] : ends[i]].tolist()
        raw = t.encode()
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        share = lambda a, b: a / max(b, 1)
        letters = sum(c.isascii() and c.isalpha() for c in t)
        want = {
            "symbols": share(sum(c in "#*$%&|<>" for c in t), len(raw)), "capitals": share(sum("A" <= c <= "Z" for c in t), letters), "exclamations": share(t.count("!"), len(raw)),
            "bare_words": share(sum(not any(c.isalnum() or ord(c) > 127 for c in w) for w in words), len(words)), "distinct_words": share(len(set(lower)), len(words)),
            "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "word_length": share(sum(len(w.encode()) for w in words), len(words)), "line_words": share(len(words), len(lines)), "words": len(words),
        }
        for name, x in want.items():
            first, e = edges[name]
            assert first + int(np.searchsorted(e, x, "left")) in f, (name, t[:40])
        assert len(set(f)) == len(f) and values[ends[i] - per[i] : ends[i]][: len(set(lower))].max(initial=0) <= 1
    assert feature[ends[0] - 1] == quality.width(1) - 1  # missing metadata


def test_only_taught_rows_teach(spark, sf):
    """Held-out labels change nothing, and taught ones do."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.quality) for r in labels.collect()]
    out = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    fit = quality.Fit(epochs=3)
    lists = {}
    for name, flip in (("plain", lambda d: False), ("held", out), ("taught", lambda d: not out(d))):
        told = spark.createDataFrame([(d, 1 - q if flip(d) else q) for d, q in rows], "doc_id long, quality int")
        lists[name] = sorted(map(tuple, quality.classify(docs.repartition(3), told, fit).collect()))
    assert lists["plain"] == lists["held"] != lists["taught"]
    assert all(h == out(d) and p == (s >= 0.5) for d, h, s, p in lists["plain"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    told = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = entries.op11_quality_classifier(spark, sf).collect()
    tested = [(r.predicted, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]
    assert len(rows) == 1000 and len(tested) > 80
    for q in (0, 1):
        assert sum(p == q for p, t in tested if t == q) >= 0.95 * sum(t == q for _, t in tested)


def test_odd_and_empty_tables(spark, odd, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    fit = quality.Fit(epochs=1)
    got = quality.classify(odd, labels, fit).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1  # repeated rows
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    few = quality.sample(odd, labels, 10, "doc_id", "text", (), "quality").collect()
    assert {r.doc_id for r in few} <= {1} and quality.sample(docs, labels, 0, "doc_id", "text", (), "quality").count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0), fit).collect()} == {0.5}
    assert quality.classify(empty, labels, fit).count() == 0
    same = {r.doc_id: r.score for r in quality.classify(docs.repartition(2), labels, fit, metadata=()).collect()}
    assert same[7] == same[8] and same == {r.doc_id: r.score for r in quality.classify(docs.repartition(11), labels, fit, metadata=()).collect()}
