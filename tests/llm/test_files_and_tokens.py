import array
import hashlib
import zlib

import pytest

from plantpulse.llm import byte_bpe, entries, html_extraction, media, packing, token_files, warc


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(entries.tokenizer_file(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)


def raw(ids):
    return array.array("I", ids).tobytes()


def test_token_files(docs, texts):
    path = entries.tokenizer_file("word_bpe_49k.json")
    encode, _ = library("word_bpe_49k.json")
    manifest, dictionary = token_files.write_token_files(docs, path)
    got = {r.doc_id: tuple(r)[1:] for r in token_files.read_token_files(manifest, dictionary).collect()}
    at, want = 0, {}
    for d, t in sorted(texts):
        ids = [*encode(t), 2]
        want[d] = (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)
    assert got == want
    one = {}
    for r in manifest.collect():
        one |= token_files.read_documents(r.path, dictionary, [4, 71])
    assert {d: x.tolist() for d, x in one.items()} == {d: [*encode(t), 2] for d, t in texts if d in (4, 71)}
    with pytest.raises(ValueError):
        token_files.read_documents(manifest.first().path, b"other", [4])


def test_packing(docs, texts):
    encode, _ = library("word_bpe_49k.json")
    out = packing.pack_documents(docs, entries.tokenizer_file("word_bpe_49k.json"), capacity=512).collect()
    want = {}
    for d, t in texts:
        ids = [*encode(t), 1]
        for p, at in enumerate(range(0, len(ids), 512)):
            want[d, p] = (at, len(ids[at : at + 512]), zlib.crc32(raw(ids[at : at + 512])))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    plain = []
    packing.best_fit([v[1] for v in want.values()], range(len(want)), plain, [], 512)
    assert len(sequences) <= len(plain)


def test_byte_bpe(docs, texts):
    encode, decode = library("byte_bpe_50k.json")
    path = entries.tokenizer_file("byte_bpe_50k.json")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.round_trip(docs, path).collect()}
    want = {}
    for d, t in texts:
        ids = encode(t)
        want[d] = (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(decode(ids).encode()).hexdigest())
    assert got == want
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path), path).collect()}
    assert back == {d: t or "" for d, t in texts}


def described(payload):
    """The features of a payload, sample by sample."""
    x = [b - 128 for b in payload]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return f"samples={len(x)};min={min(x)};max={max(x)};sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings}"


def test_media(docs, texts):
    column = media.media_column(docs)
    got = {r.doc_id: r for r in media.media_features(column).collect()}
    streams = {r.doc_id: bytes(r.media) for r in column.collect()}
    for d, t in texts:
        p = (t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64))
        signed = bytes(b ^ 0x80 for b in p)
        r = got[d]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(signed), hashlib.sha256(signed).hexdigest(), described(p))
        assert (r.flac_bytes, r.flac_sha256) == (len(streams[d]), hashlib.sha256(streams[d]).hexdigest())
    assert len(got) == len(texts)
    for d, t in texts:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), media.feature(p))
    blocks = {}
    for r in media.pcm_blocks(column.filter("doc_id = 71"), 16).collect():
        blocks[r.sample_offset] = bytes(x ^ 0x80 for x in r.pcm)
    assert b"".join(blocks[k] for k in sorted(blocks)).startswith(dict(texts)[71].encode())


PAGES = "page_id long, url string, html string, refers_to string, sha1 string"


def test_warc(spark):
    htmls = ["a" * 999, "a" * 999, "b" * 1000, "b" * 1000, "b" * 1000, None, "", "é" * 500, "é" * 500, "x\r\n\r\ny" * 300]
    rows = [(i, None if i == 3 else f"http://h/{i}?q=1\n", h, None, "s") for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(pages).collect()}
    last = {}
    for i, h in enumerate(htmls):
        b = (h or "").encode()
        last[b] = i if len(b) >= 1000 else None
    for i, h in enumerate(htmls):
        b = (h or "").encode()
        to = last[b] if last[b] is not None and last[b] != i else None
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to)
    whole = warc.transactions(warc.read_records(warc.write_archives(pages))).collect()
    assert len(whole) == 10 and all(r.request.type == "request" and r.metadata is not None for r in whole)
    assert {bytes(r.response.payload).decode() for r in whole if r.response.type == "response"} == {h or "" for h in htmls}
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "u", "c" * 2000, None, None), (5, "u", "c" * 2000, None, None), (5, "u", "c" * 2000, None, None), (4, "[", "c" * 2000, None, None)], PAGES)
    found = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.captures(odd).collect())
    assert found == [(-1, "response", None, 0), (-1, "response", None, 2000), (4, "revisit", 5, 2000), (5, "response", None, 2000), (5, "response", None, 2000)]
    assert warc.captures(spark.createDataFrame([], PAGES)).count() == 0


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>menu</a></li></ul></nav><div class=ad>buy</div><article><h1>Head line</h1><p>One &amp; two.<p>Three\n\n four five six.</article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", page, None, None), (2, None, None, None, None), (None, "u", "", None, None), (1, "u", page, None, None)], PAGES)
    got = html_extraction.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Head line One & two. Three four five six.", 41), (1, "Head line One & two. Three four five six.", 41), (2, "", 0)]
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_odd_and_empty_tables(odd, empty):
    path, bytes_path = entries.tokenizer_file("word_bpe_49k.json"), entries.tokenizer_file("byte_bpe_50k.json")
    for f in (lambda d: token_files.token_files(d, path), lambda d: packing.pack_documents(d, path), lambda d: byte_bpe.round_trip(d, bytes_path), lambda d: media.media_features(media.media_column(d))):
        assert f(odd).count() == 7
        assert f(empty).count() == 0
