"""Token ids as binary shard files, each document compressed on its own.

A zstandard dictionary is trained on the serialized id arrays of a bounded
sample of documents; every document is then one frame under that dictionary,
so a short document compresses well and is read without its neighbours.

A shard file:

    8 bytes   magic
    32 bytes  SHA-256 of the dictionary (zeros without one)
    frames    one for each document: its ids as little-endian integers
    index     doc_ids int64, frame ends uint64, id counts uint32
    24 bytes  documents uint64, index start uint64, bytes an id uint64

Shards hold ascending ranges of doc_id.  Each task writes a file of its own
name and reports it; the manifest, a table written by Spark, names the files
of the tasks that succeeded, so retried or doubled tasks leave no trace in it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf, word_encoder

MAGIC = b"TOKSHRD1"
MANIFEST = "first_doc long, shard int, path string, n_docs long, n_tokens long"


def _numbers(ids: np.ndarray, bytes_an_id: int) -> bytes:
    return ids.astype("<u2" if bytes_an_id == 2 else "<u4").tobytes()


def _documents(texts, path: str, end_id: int):
    """The ids of each text with the end id."""
    ids, per = word_encoder.encode(texts, path)
    ends = np.cumsum(per).tolist()
    end = np.array([end_id], np.uint32)
    for i, j in zip([0, *ends[:-1]], ends):
        yield np.concatenate([ids[i:j], end])


def _vocabulary_bytes(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 65536 else 4


def train_dictionary(docs: DataFrame, path: str, end_id: int, bytes_an_id: int, size: int = 65536, sample: int = 1000, most: int = 32768) -> bytes:
    """A dictionary from the ``sample`` documents with the least id hashes,
    at most ``most`` bytes of each.  Few documents give no dictionary."""

    def serialized(batches):
        for b in textbuf.slices(batches, "text"):
            yield pa.record_batch([pa.array([_numbers(x[:most], bytes_an_id)[:most] for x in _documents(b.column("text"), path, end_id)], pa.binary())], ["ids"])

    # ids first: only they are sorted, and at most ``sample`` of them are joined;
    # of rows that repeat an id the least text, so that no more come to the driver
    ids = docs.filter("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    rows = [r.ids for r in chosen.mapInArrow(serialized, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _write(folder: str, path: str, end_id: int, bytes_an_id: int, dictionary: bytes, level: int):
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)

    def run(batches):
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        fs, where = pafs.FileSystem.from_uri(folder)
        out = None
        doc_ids, ends, sizes, at = [], [], [], 40
        for b in textbuf.slices(batches, "text"):
            if out is None:
                fs.create_dir(where, recursive=True)
                name = f"{where}/{uuid.uuid4().hex}.tok"
                out = fs.open_output_stream(name)
                out.write(MAGIC + digest)
            frames = []
            for ids in _documents(b.column("text"), path, end_id):
                frames.append(z.compress(_numbers(ids, bytes_an_id)))
                at += len(frames[-1])
                ends.append(at)
                sizes.append(len(ids))
            doc_ids.append(b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
            out.write(b"".join(frames))
        if out is None:
            return
        docs = np.concatenate(doc_ids)
        out.write(docs.astype("<i8").tobytes() + np.array(ends, "<u8").tobytes() + np.array(sizes, "<u4").tobytes() + np.array([len(docs), at, bytes_an_id], "<u8").tobytes())
        out.close()
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        yield pa.record_batch([pa.array([int(docs[0])]), pa.array([shard], pa.int32()), pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(docs)]), pa.array([int(sum(sizes))])], ["first_doc", "shard", "path", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Write all documents in ascending doc_id order; (manifest, dictionary).

    Null texts are empty; null ids come first; rows that repeat an id follow
    the hash of their texts.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    root = scratch.root(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = _vocabulary_bytes(tokenizer, end_id)
    dictionary = train_dictionary(rows, tokenizer, end_id, width)
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = scratch.stored(placed.mapInArrow(_write(f"{root}/tokens", tokenizer, end_id, width, dictionary, level), MANIFEST), f"{root}/manifest")
    return manifest, dictionary


def open_shard(path: str):
    """(file, dictionary hash, doc_ids, frame bounds, id counts, bytes an id)."""
    fs, where = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(where)
    size = f.size()
    n, start, width = np.frombuffer(f.read_at(24, size - 24), "<u8").astype(np.int64).tolist()
    raw = f.read_at(size - 24 - start, start)
    doc_ids, ends, counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n)
    head = f.read_at(40, 0)
    if head[:8] != MAGIC:
        raise ValueError(f"{path} is no token shard")
    return f, head[8:], doc_ids, np.concatenate([[40], ends.astype(np.int64)]), counts, width


def _decompressor(dictionary: bytes, digest: bytes):
    if digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
        raise ValueError("the shard was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_documents(path: str, dictionary: bytes, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of a shard, reading only the index and their frames."""
    f, digest, have, bounds, _, width = open_shard(path)
    z = _decompressor(dictionary, digest)
    out = {}
    for d in doc_ids:
        i = int(np.searchsorted(have, d))
        if i < len(have) and have[i] == d:
            out[d] = np.frombuffer(z.decompress(f.read_at(int(bounds[i + 1] - bounds[i]), int(bounds[i]))), "<u2" if width == 2 else "<u4").astype(np.uint32)
    return out


def _read(dictionary: bytes):
    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                f, digest, doc_ids, bounds, counts, width = open_shard(path)
                z = _decompressor(dictionary, digest)
                for lo in range(0, len(doc_ids), 512):
                    hi = min(lo + 512, len(doc_ids))
                    raw = memoryview(f.read_at(int(bounds[hi] - bounds[lo]), int(bounds[lo])))
                    n, crc, starts = [], [], []
                    for i in range(lo, hi):
                        ids = np.frombuffer(z.decompress(raw[bounds[i] - bounds[lo] : bounds[i + 1] - bounds[lo]]), "<u2" if width == 2 else "<u4")
                        if len(ids) != counts[i]:
                            raise ValueError(f"{path}: frame {i} has {len(ids)} ids, the index {counts[i]}")
                        n.append(len(ids))
                        starts.append(base)
                        base += len(ids)
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    docs = doc_ids[lo:hi]
                    yield pa.record_batch([pa.array(docs, mask=docs == np.iinfo(np.int64).min), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    One row a document written, in any order; a document without an id keeps its
    null.  An empty manifest gives an empty result; a file that ends early or
    names another dictionary raises.
    """
    order = W.orderBy("first_doc", "shard").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long"))).select("path", "base")
    # a task for each file: rows this small would else be put into one
    return based.repartitionByRange(max(1, manifest.count()), "path").mapInArrow(_read(dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents and describe them from the files, read back.

    doc_id, start, n_tokens, ids_crc32: a row an input row, ids in ascending
    order.  Null and empty texts hold the end id alone, texts of any length are
    encoded whole, rows that repeat an id are documents of their own, other
    columns are ignored; an empty table gives an empty result.
    """
    return read_token_files(*write_token_files(docs, tokenizer, end_id))
