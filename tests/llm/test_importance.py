import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import entries, importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(rows, targets, percent=25, least=20, buckets=10_000, seed="7"):
    """rows: (doc_id, text); sorted (doc_id, n_features, weight, score, rank)."""
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(place, grams(text)[1]))
    for text in targets:
        t.update(map(place, grams(text)[1]))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for d, text in rows:
        n, found = grams(text)
        weight = sum(gain(place(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-x[3], x[0] is None, x[0] or 0, -x[2], i) for i, x in enumerate(out) if x[4] >= least)
    rank = {x[4]: r for r, x in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((*x[:4], rank.get(i)) for i, x in enumerate(out)) if None not in [d for d, _ in rows] else [(*x[:4], rank.get(i)) for i, x in enumerate(out)]


def found(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_resampling_equals_brute_force(spark, docs, texts):
    targets = [texts[40][1], "漢字 AND and", None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    assert found(importance.resample(docs, target)) == brute(texts, targets)
    half = importance.Draw(percent=50, min_words=1, buckets=97, seed="x")
    assert found(importance.resample(docs.repartition(3), target, half)) == brute(texts, targets, 50, 1, 97, "x")


@pytest.mark.parametrize("margins", [(), (0.0,), (0.5,)])
def test_a_bracket_that_misses_is_widened(spark, margins):
    """Scores with a heap of ties, and margins that hold too little or nothing."""
    rng = random.Random(3)
    rows = [(i, 5, 0, 100 if i % 3 else rng.randrange(1000), True, i) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean, row long").repartition(6)
    order = sorted((-r[3], r[0]) for r in rows)
    for wanted in (1, 100, 750, 2000, 3000):
        low, high, above = importance.bracket(scored, wanted, 3000, margins)
        assert low <= -order[wanted - 1][0] <= high and above == sum(-s > high for s, _ in order)


def test_ranks_over_many_partitions(spark, tmp_path):
    rows = [(i // 2, 0, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, weight long, score long").withColumn("row", F.monotonically_increasing_id())
    got = importance.ranked(df.repartition(9), tmp_path.as_uri() + "/r", 11).collect()
    assert sorted(r["rank"] for r in got) == list(range(11, 5011))
    assert [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((s, d) for d, _, s in rows), key=lambda x: (-x[0], x[1]))


def test_checksums_of_spans():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 47, 48, 49, 500, 3, 3)]
    ends = np.cumsum([len(w) for w in words])
    buf = np.frombuffer(b"".join(words), np.uint8)
    starts = ends - [len(w) for w in words]
    assert importance.crc_spans(buf, starts, ends).tolist() == [zlib.crc32(w) for w in words]
    before = np.array([zlib.crc32(b"ab ")] * len(words), np.uint32)
    assert importance.crc_spans(buf, starts, ends, before).tolist() == [zlib.crc32(b"ab " + w) for w in words]


def test_odd_and_empty_tables(spark, odd, empty):
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = importance.resample(odd, target).collect()
    plain = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(plain((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in got) == sorted(map(plain, brute(rows, ["w1 w2"])))
    assert importance.resample(empty, target).count() == 0
    assert {r["rank"] for r in importance.resample(odd.filter("text is null"), target.limit(0)).collect()} == {None}


def test_registered_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(entries.op13_importance_resampling(spark, sf)) == brute(docs, targets)
