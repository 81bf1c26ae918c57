from collections import Counter

import brute
import numpy as np
import pyarrow as pa

from plantpulse.llm import near_dedup, quality_rules, repeats, scratch, substring_dedup, suffix_dedup, textbuf


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality_counts(docs, texts):
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.quality_rules(docs).collect()}
    assert got == {d: brute.quality(t) for d, t in texts}


def test_quality_lines_count_distinct_documents_of_a_host(spark):
    boiler = " ".join(f"b{i}" for i in range(40))
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    rows = [(i, f"{own(i)}\n{boiler}", "h1") for i in range(12)] + [(100 + i, f"{own(0)}\n{own(7)}", "h2") for i in range(30)] + [(200, f"{own(200)}\n{boiler}", "h3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = quality_rules.LineLimits(min_documents=10, max_share=0.1)
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.quality_rules(df, limits).collect()}
    # 40 of 70 words stand on a line of 12 documents of the host: depleted
    assert all(got[i] == (40, False) for i in range(12))
    # thirty copies are one document: their lines are no boilerplate
    assert all(got[100 + i] == (0, True) for i in range(30))
    assert got[200] == (0, True)
    stage = quality_rules.passing(df, limits)
    assert stage.columns == df.columns
    assert {r.doc_id for r in stage.collect()} == {d for d, (_, kept) in got.items() if kept}


def test_quality_stage_cuts_frequent_lines(spark):
    boiler = " ".join(f"B{i}" for i in range(20))
    own = lambda i: " ".join(f"é{i}x{j}" for j in range(60))
    texts = [f"{boiler}\n{own(i)}\n\n {boiler.lower()} \nend {i}" if i % 2 else f"{own(i)}\n{boiler}" for i in range(12)] + [f"\n{own(50)}\nlast\n", None]
    df = spark.createDataFrame([(i, t, "h", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int")
    limits = quality_rules.LineLimits(min_documents=10, max_share=0.1)
    got = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.passing(df, limits).collect()}
    want = [f"{own(i)}\n\nend {i}" if i % 2 else f"{own(i)}\n" for i in range(12)] + [texts[12]]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_near_dedup_equals_brute_force(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs, 85).collect()}
    assert got == brute.near(texts, 85)
    stage = near_dedup.without_near_duplicates(docs)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == {d for d, v in brute.near(texts).items() if v[2]}


def test_near_dedup_refines_crowded_regions(docs, texts, monkeypatch):
    # closures carry module globals of driver and worker apart: only the driver's limits change the levels used
    monkeypatch.setattr(near_dedup, "REGION", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(docs, 85).collect()}
    assert got == brute.near(texts, 85)


def test_near_dedup_joins_crowds_with_unique_changes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 20)
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    base = [f"w{i}" for i in range(250)]
    changed = lambda words, at, tag: " ".join(f"{tag}x{i}" if i in at else w for i, w in enumerate(words))
    # a crowd whose members share no changed word
    rows = [(i, changed(base, {(7 * i) % 250, (11 * i + 100) % 250}, f"u{i}")) for i in range(140)]
    # texts beside the crowd, in the same clump: each links to the next one only
    drift = base
    for i in range(140, 170):
        drift = changed(drift, set(range(8 * (i - 140), 8 * (i - 140) + 8)), "d").split()
        rows.append((1000 - i, " ".join(drift)))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 85).collect()}
    assert got == brute.near(rows, 85)


def test_near_dedup_follows_its_threshold(spark):
    assert near_dedup.levels(85) == [(4, 16), (8, 128), (10, 256)] and near_dedup.likely(85) == 40
    for percent in (70, 80, 85, 95):
        assert all(near_dedup.missed(percent, d, n) <= near_dedup.MISSED for d, n in near_dedup.levels(percent))
        assert sum(near_dedup._agreeing(percent)[: near_dedup.likely(percent)]) <= 5e-6
    # 40 pairs of 236 shingles with 5 changed words: similarity 211 / 261 = 0.808
    pairs = [[f"p{i}w{j}" for j in range(240)] for i in range(40)]
    rows = [(2 * i + k, " ".join("new" if k and j % 48 == 20 else w for j, w in enumerate(p))) for i, p in enumerate(pairs) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.without_near_duplicates(df, 80).collect()} == set(range(0, 80, 2))
    assert near_dedup.without_near_duplicates(df, 85).count() == 80


def test_near_dedup_of_six_thousand_copies_with_unique_changes(spark):
    base = [f"w{i}" for i in range(250)]
    rows = [(i, " ".join(f"u{i}x{j}" if j in ((7 * i) % 250, (7 * i + 100) % 250) else w for j, w in enumerate(base))) for i in range(6000)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 85).collect()
    assert len(got) == 6000 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_dedup_judges_texts_of_one_id_by_themselves(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (4, b + " more")], "doc_id long, text string")
    got = rows_of(near_dedup.near_dedup(df), "doc_id", "component_id", "kept")
    assert got == Counter({(3, 3, True): 1, (5, 3, False): 1, (5, 4, False): 1, (7, 4, False): 1, (4, 4, True): 1})
    assert rows_of(near_dedup.without_near_duplicates(df), "doc_id", "text") == Counter({(3, a): 1, (4, b + " more"): 1})
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (8, b + " more")], "doc_id long, text string")
    assert rows_of(near_dedup.without_near_duplicates(df), "doc_id", "text") == Counter({(3, a): 1, (5, b): 1})


def test_subtrees_are_no_deeper_than_needed():
    rng = np.random.default_rng(4)
    labels = np.zeros((500, near_dedup.VALUES), np.uint8)
    labels[:, :20] = rng.integers(0, 2, (500, 20))
    labels[:60] = 7
    labels = labels[np.lexsort(labels.T[::-1])]
    prefixes = near_dedup._common_prefixes(labels)
    for i in range(1, 500):
        same = labels[i] == labels[i - 1]
        assert prefixes[i] == (near_dedup.VALUES if same.all() else same.argmin())
    parts = near_dedup.subtrees(prefixes, 0, 500, 50)
    assert [i for i, _ in parts[1:]] == [j for _, j in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == 500
    assert all(0 < j - i <= 50 for i, j in parts) and near_dedup.subtrees(prefixes, 3, 40, 50) == [(3, 40)]
    # a cut is where a smaller prefix would leave too many together
    cuts = [i for i, _ in parts[1:]]
    assert np.mean(prefixes[cuts]) < np.mean(prefixes[1:]) / 2 or max(prefixes[cuts]) == near_dedup.VALUES


def test_hot_anchors_are_divided_without_loss(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.substring_dedup(docs, hot=3)).collect()}
    assert got == brute.word_windows(texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, hot=3)).collect()}
    assert got == brute.byte_strings(texts)


def test_resolved_rows_do_not_hang_on_the_partitions(spark, docs):
    rows = repeats.identified(docs)
    w = substring_dedup._windows(20, 8, 50_000)
    path = scratch.root(spark)
    found = scratch.stored(repeats.candidates(rows, w, path, repeats.sketch(rows, w, path)), path + "/found")
    dealt = [found.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(substring_dedup._resolve, repeats.REMOVED) for n in (2, 64)]
    assert dealt[0].count() == dealt[1].count() > 0


def test_a_group_larger_than_a_chunk_keeps_its_earliest_windows(monkeypatch):
    rng = np.random.default_rng(6)
    doc, n = rng.permutation(90), 3
    hashes = rng.integers(0, 9, (90, n)).astype(np.uint64)
    anchor = np.sort(rng.integers(0, 3, 90))
    table = pa.table({"anchor": anchor, "doc_id": doc, "row_key": np.zeros(90, np.int64), "start": np.zeros(90, np.int32), "n": np.full(90, n, np.int32), "data": pa.array([h.tobytes() for h in hashes], pa.binary()), "runs": pa.nulls(90, pa.binary())})
    whole = textbuf.group_chunks
    flagged = []
    for most in (8_000_000, 400):
        monkeypatch.setattr(textbuf, "group_chunks", lambda b, c, most=most: whole(b, c, most))
        out = [x for b in substring_dedup._resolve(table.to_batches(7)) for x in b.to_pylist()]
        flagged.append({(x["doc_id"], s + i) for x in out for s, m in [np.frombuffer(x["runs"], "<i4").tolist()] for i in range(m)})
    first = {}
    for a, d, h in sorted(zip(anchor.tolist(), doc.tolist(), hashes.tolist()), key=lambda x: x[1]):
        for i, x in enumerate(h):
            first.setdefault((a, x), (d, i))
    want = {(d, i) for a, d, h in zip(anchor.tolist(), doc.tolist(), hashes.tolist()) for i, x in enumerate(h) if first[a, x] != (d, i)}
    assert flagged == [want, want]


def test_substring_dedup_equals_brute_force(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.substring_dedup(docs)).collect()}
    assert got == brute.word_windows(texts)
    stage = substring_dedup.without_repeats(docs)
    assert stage.columns == docs.columns
    for r in stage.collect():
        assert len(brute.WORD.findall(r.text or "")) == got[r.doc_id][0] - got[r.doc_id][1]
        assert r.text is None or r.n_chars == len(r.text)


def test_suffix_dedup_equals_brute_force(docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.suffix_dedup(docs)).collect()}
    assert got == brute.byte_strings(texts)


def test_empty_tables(empty):
    for f in (quality_rules.quality_rules, near_dedup.near_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, quality_rules.passing, near_dedup.without_near_duplicates, substring_dedup.without_repeats):
        assert f(empty).count() == 0


def test_odd_rows_have_defined_results(odd):
    assert rows_of(quality_rules.quality_rules(odd), "doc_id", "n_words", "kept") == Counter({(None, 60, True): 1, (None, 0, False): 1, (1, 60, True): 2, (2, 60, True): 1, (2, 2, False): 1, (3, 0, False): 1})
    near = rows_of(near_dedup.near_dedup(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert near == Counter({(None, 56, None, True): 1, (None, 0, None, True): 1, (1, 56, 1, True): 2, (2, 56, 1, False): 1, (2, 1, 2, True): 1, (3, 0, 3, True): 1})
    words = rows_of(substring_dedup.substring_dedup(odd), "doc_id", "n_words", "n_removed")
    assert words == Counter({(None, 60, 0): 1, (None, 0, 0): 1, (1, 60, 0): 2, (2, 60, 60): 1, (2, 2, 0): 1, (3, 0, 0): 1})
    removed = Counter(r.n_removed > 0 for r in suffix_dedup.suffix_dedup(odd).collect())
    assert removed == Counter({False: 6, True: 1})
