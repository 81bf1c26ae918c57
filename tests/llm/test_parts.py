import os
import random
import time

import brute
import numpy as np
import other_pages
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import flac, html_extraction, labelled_pages, media, packing, repeats, textbuf
from plantpulse.llm.components import components
from plantpulse.llm.html_blocks import blocks
from plantpulse.llm.suffix_array import permuted_lcp, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=80), st.sampled_from([4, 5000]))
def test_suffix_array_and_common_prefixes(body, k):
    s = [*body, 0]
    sa = suffix_array(np.array(s), k).tolist()
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    plcp = permuted_lcp(np.array(s), np.array(sa))
    for x, y in zip(sa, sa[1:]):
        n = 0
        while s[x + n] == s[y + n]:
            n += 1
        assert plcp[y] == n


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t", max_size=60), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    import re

    buf, offs = textbuf.flat(pa.array(texts, pa.string()))
    ws, we = textbuf.words(buf, offs)
    raw = buf.tobytes()
    assert [raw[i:j].decode() for i, j in zip(ws, we)] == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(3)
    per = np.array([0, 5, 120, 19, 20, 300])
    values = textbuf.mix(rng.integers(0, 4, per.sum()).astype(np.uint64))
    w = repeats.Windows(20, 8, False)
    start, n, _, at = repeats.runs(values, per, w)
    covered = repeats.expand(start, n)
    assert covered.tolist() == np.flatnonzero(textbuf.inside(per, 20)).tolist()
    assert ((np.repeat(at, n) >= covered) & (np.repeat(at, n) <= covered + 12)).all()


def test_components_follow_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)] + [(400, i) for i in range(401, 440)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == want


def test_flac_round_trip_seek_and_checksums():
    rng = random.Random(2)
    payloads = [bytes(64), b"a" * 64, os.urandom(2048), b"hello world, this is text " * 200 + bytes(24), bytes(rng.choice(b"abc de") for _ in range(5000))]
    payloads += [bytes([0, 255] * 700), b"\x80" * 1500 + b"\xff" + b"\x80" * 1500]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.decode(streams[3:4], [range(1500, 2100)]) == [payloads[3][1500:2100]]
    info = flac.stream_info(streams[3])
    bare = streams[3][:4] + bytes([0x80]) + streams[3][5:42] + streams[3][info["frames_at"] :]
    assert flac.decode([bare]) == [payloads[3]]  # without a seek table, frame after frame
    damaged = bytearray(streams[3])
    damaged[-30] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode([bytes(damaged)])


def test_flac_reads_partitions_and_escapes():
    """A hand-made frame: 16 samples, fixed order 0, two partitions, one escaped."""
    samples = [3, -2, 0, 1, 5, -5, 2, 2, 7, -8, 0, 1, -1, 6, -6, 3]
    bits = "00010000" + "00" + "0001"
    bits += format(1, "04b")
    for v in samples[:8]:
        u = 2 * v if v >= 0 else -2 * v - 1
        bits += "0" * (u >> 1) + "1" + str(u & 1)
    bits += "1111" + format(4, "05b") + "".join(format(v & 15, "04b") for v in samples[8:])
    bits += "0" * (-len(bits) % 8)
    frame = flac._frame_header(0, 16) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    crc = int(flac.crc16_lanes(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    got, ends = flac.decode_frames(frame + crc.to_bytes(2, "big"), [0])
    assert got[0].tolist() == samples and ends == [len(frame) + 2]


def test_genetic_packing_beats_or_equals_best_fit():
    rng = np.random.default_rng(0)
    for seed in range(4):
        lengths = rng.integers(20, 70, 120).tolist()
        first = []
        packing.best_fit(lengths, range(len(lengths)), first, [], 100)
        best = packing.evolve(lengths, 100, [], np.random.default_rng(seed), generations=30)
        assert sorted(i for b in best for i in b) == list(range(120))
        assert all(sum(lengths[i] for i in b) <= 100 for b in best)
        assert packing.fitness(best, lengths, 100) >= packing.fitness(first, lengths, 100)
        child = packing.crossover(first, best, lengths, 100, np.random.default_rng(1))
        assert sorted(i for b in child for i in b) == list(range(120))


def test_crossovers_save_bins_where_there_is_room_to_win():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1000, 2401, 1500).tolist()
    first = []
    packing.best_fit(lengths, range(len(lengths)), first, [], 4096)
    best = packing.evolve(lengths, 4096, [], np.random.default_rng(1))
    bound = -(-sum(lengths) // 4096)
    assert sorted(i for b in best for i in b) == list(range(1500)) and all(sum(lengths[i] for i in b) <= 4096 for b in best)
    assert len(best) - bound < (len(first) - bound) / 2


def test_exchanged_pieces_fill_bins():
    lengths, bins, room = [50, 40, 30, 20, 60, 55, 21], [[0, 1], [2, 3]], [10, 50]
    left = packing.exchange(lengths, [4, 5, 6], bins, room)
    assert sorted(left + bins[0] + bins[1]) == list(range(7))
    assert [100 - sum(lengths[i] for i in b) for b in bins] == room and sum(room) < 60 and min(room) >= 0


def test_genetic_packing_crosses_even_where_best_fit_is_enough(monkeypatch):
    calls = []
    crossing = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *x: calls.append(1) or crossing(*x))
    packing.evolve([50] * 20, 100, [], np.random.default_rng(0))
    assert len(calls) == 1
    packing.evolve([60] * 20, 100, [], np.random.default_rng(0), generations=5)
    assert len(calls) == 6
    assert packing.evolve([], 100, [], np.random.default_rng(0)) == []


def test_viterbi_equals_trying_all_labels():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 4, 0, 7, 2])
    for _ in range(20):
        model = html_extraction.Model({}, np.zeros((0, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=(int(lengths.sum()), 2))
        at, want = 0, []
        for n in lengths.tolist():
            if n:
                want += brute.viterbi(scores[at : at + n].tolist(), model.transitions.tolist(), model.first.tolist())
            at += n
        assert model.viterbi(scores, lengths).tolist() == want


def test_slopes_equal_differences():
    rng = np.random.default_rng(9)
    pages = [[tuple(f"f{i}" for i in np.flatnonzero(rng.random(5) < 0.5)) for _ in range(n)] for n in (1, 3, 5)]
    index = {f"f{i}": i for i in range(5)}
    data = html_extraction._examples(pages, [rng.integers(0, 2, len(p)).tolist() for p in pages], index)
    params = [rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]
    _, slopes = html_extraction.objective(params, data, 0.01)
    for p, slope in zip(params, slopes):
        for at in np.ndindex(p.shape):
            values = []
            for step in (1e-5, -2e-5):
                p[at] += step
                values.append(html_extraction.objective(params, data, 0.01)[0])
            p[at] += 1e-5
            assert abs((values[0] - values[1]) / 2e-5 - slope[at]) < 1e-4


def test_long_and_deep_pages_take_linear_time():
    model = html_extraction.default_model(100)
    for piece in ("<div>x ", '<a "x ', "<p class='", "<b class=w{}>x", "<i>", "</section>x<section>", "<!-- ", "<td><ul>"):
        pages = ["".join(piece.format(i) for i in range(n)) for n in (10_000, 40_000)]
        took = []
        for page in pages:
            began = time.perf_counter()
            html_extraction.main_texts([page], model)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 1, piece


def test_main_text_of_pages_from_elsewhere():
    model = html_extraction.default_model()
    for html, want in other_pages.PAGES:
        assert html_extraction.main_texts([html], model)[0] == want


def test_labels_of_unseen_layouts():
    model = html_extraction.default_model(200)
    right = total = 0
    for seed in range(9000, 9060):
        html, labels = labelled_pages.page(seed)
        page = blocks(html)
        got = model.viterbi(model.emissions([html_extraction.features(page)]), np.array([len(page)])).tolist()
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97


def test_blocks_of_careless_pages():
    assert blocks("") == []
    found = blocks("<body><p>a&amp;b <b>c<br>d<p>e<ul><li>f<li><a href='x>y'>g</a></ul><script>var t='</p>';</script>h<!-- i --><div class=ad>j")
    assert [b.text for b in found] == ["a&b c d", "e", "f", "g", "h", "j"]
    assert found[3].linked == 1 and found[5].path[-1] == ("div", ("ad",))
    assert blocks("<article><p>cut off <a hre")[0].text == "cut off"


def test_pcm_blocks_are_found_by_their_samples(spark, docs, texts):
    stored = media.pcm_column(media.media_column(docs.filter("doc_id in (1, 6, 71, 72)")), 1000).collect()
    assert sorted(r.doc_id for r in stored) == [1, 6, 71, 72]
    for r in stored:
        raw = (dict(texts)[r.doc_id] or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r.n_bytes == len(raw) and [b.sample_offset for b in r.blocks] == list(range(0, len(whole), 1000))
        for b in r.blocks:
            assert bytes(x ^ 0x80 for x in b.pcm) == whole[b.sample_offset : b.sample_offset + b.n_samples]
    again = media.pcm_blocks(media.media_column(docs.filter("doc_id = 72")), 1000).orderBy("block").collect()
    long = next(r for r in stored if r.doc_id == 72).blocks
    assert [(r.block, r.sample_offset, r.n_samples, bytes(r.pcm)) for r in again] == [(i, b.sample_offset, b.n_samples, bytes(b.pcm)) for i, b in enumerate(long)]
    assert media.pcm_column(media.media_column(docs.limit(0))).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_shingles_and_bitmaps_lose_no_link(percent):
    """Groups of all similarities, some linked: stars over the index reach what all pairs reach."""
    from plantpulse.llm import near_dedup

    rng = random.Random(percent)
    texts = []
    for base in range(3):
        words = [f"b{base}x{i}" for i in range(rng.randint(60, 200))]
        for k in range(80):
            t = list(words)
            for j in rng.sample(range(len(t)), rng.randint(1, 8)):
                t[j] = f"u{base}x{k}x{j}"
            texts.append(" ".join(t[: rng.randint(len(t) - 10, len(t))]))
    rng.shuffle(texts)
    sets, sizes = near_dedup.shingle_sets(pa.array(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    whole = [set(sets[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    linked = lambda i, j: 100 * len(whole[i] & whole[j]) >= percent * len(whole[i] | whole[j])
    index = near_dedup._Rare(sets, bounds, 0, len(texts), percent)
    tried = 0
    for i in range(len(texts)):
        others = np.array([j for j in range(len(texts)) if j != i and rng.random() < 0.7])
        got = others[index.candidates(i, others)].tolist()
        tried += len(got)
        assert {j for j in others.tolist() if linked(i, j)} <= set(got)
    assert tried < 0.5 * len(texts) ** 2

    def roots(edges):
        up = list(range(len(texts)))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in edges:
            up[find(a)] = find(b)
        return [find(i) for i in range(len(texts))]

    near = near_dedup._linker(sets, sizes, [(0, len(texts))], percent)
    stars = near_dedup._stars(np.arange(len(texts)), [(0, len(texts))], near)
    got = roots(zip(stars.column(0).to_pylist(), stars.column(1).to_pylist()))
    want = roots((i, j) for i in range(len(texts)) for j in range(i) if linked(i, j))
    same = lambda r: {tuple(i for i in range(len(r)) if r[i] == x) for x in set(r)}
    assert same(got) == same(want) and len(same(want)) > 3
