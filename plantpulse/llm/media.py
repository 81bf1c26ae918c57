"""Media columns: payloads as FLAC, decoded to stored PCM blocks, read back and measured."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import flac, scratch, textbuf

UNIT = 64


def _payloads(texts) -> tuple[list[bytes], list[int]]:
    """Each text's bytes, padded with zeros to a positive multiple of 64."""
    buf, offs = textbuf.flat(texts)
    raw, at = buf.tobytes(), offs.tolist()
    out = [raw[i:j] for i, j in zip(at[:-1], at[1:])]
    return [p + bytes(-len(p) % UNIT if p else UNIT) for p in out], np.diff(offs).tolist()


def _encode(batches):
    for b in textbuf.slices(batches, "text"):
        payloads, sizes = _payloads(b.column("text"))
        yield pa.record_batch([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(flac.encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``media``, the text's bytes as a FLAC stream.

    A null or empty text is 64 zero bytes.  One row per input row, whatever
    its id; other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def feature(payload: bytes) -> str:
    """Integer features of the samples, so that no rounding enters."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"samples={len(x)};min={x.min()};max={x.max()};sum={x.sum()};energy={(x * x).sum()};crossings={crossings}"


def _pcm(block: int):
    def run(batches):
        for b in textbuf.slices(batches, "media"):
            streams = b.column("media").to_pylist()
            payloads = flac.decode(streams)
            sizes = np.array([len(p) for p in payloads], np.int64)
            per = -(-sizes // block)
            number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            held = np.minimum(np.repeat(sizes, per) - number * block, block)
            # blocks of a payload follow each other, so they are cuts of one buffer
            samples = np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80
            cuts = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            pcm = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(cuts), pa.py_buffer(samples)])
            parts = pa.StructArray.from_arrays([pa.array(number * block), pa.array(held.astype(np.int32)), pcm], ["sample_offset", "n_samples", "pcm"])
            yield pa.record_batch(
                [b.column("doc_id"), b.column("n_bytes"), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), textbuf.lists(per, parts)],
                ["doc_id", "n_bytes", "flac_bytes", "flac_sha256", "blocks"],
            )

    return run


def pcm_column(media: DataFrame, block: int = 4096) -> DataFrame:
    """Streams decoded, with all their checksums, to ``blocks`` of samples.

    doc_id, n_bytes, the stream's size and SHA-256, and an array of
    (sample_offset, n_samples, signed 8-bit ``pcm``), so that a block is found
    from the sample it holds.  One row a stream; a null or damaged stream raises,
    an empty table gives an empty result.
    """
    schema = "doc_id long, n_bytes long, flac_bytes long, flac_sha256 string, blocks array<struct<sample_offset: long, n_samples: int, pcm: binary>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_pcm(block), schema)


def pcm_blocks(media: DataFrame, block: int = 4096) -> DataFrame:
    """doc_id, block, sample_offset, n_samples and signed 8-bit ``pcm``: a row a block.

    Streams are as in ``pcm_column``."""
    return pcm_column(media, block).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.sample_offset", "b.n_samples", "b.pcm")


def _features(batches):
    for b in batches:
        blocks = b.column("blocks")
        raw, cuts = textbuf.flat(pc.struct_field(blocks.flatten(), "pcm"))
        ends = np.cumsum(pc.list_value_length(blocks).to_numpy(zero_copy_only=False))
        at = cuts[np.concatenate([[0], ends]).astype(np.int64)].tolist()
        stored = [raw[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
        payloads = [(raw[i:j] ^ 0x80).tobytes() for i, j in zip(at[:-1], at[1:])]
        yield pa.record_batch(
            [
                b.column("doc_id"), b.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()), pa.array([len(x) for x in stored], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                pa.array([feature(p) for p in payloads]), b.column("flac_bytes"), b.column("flac_sha256"),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "flac_bytes", "flac_sha256"],
        )


def media_features(media: DataFrame) -> DataFrame:
    """Store every stream's PCM blocks in the shared folder, read them back and measure them.

    All of payload, media and feature columns come from the stored blocks:
    media_bytes and media_sha256 are of their signed samples in order, as
    stored.  flac_bytes and flac_sha256 are of the stream they were decoded from.
    A null or empty text is 64 zero samples; an empty table gives an empty result.
    """
    path = scratch.root(media.sparkSession) + "/pcm"
    pcm = scratch.stored(pcm_column(media), path, "zstd")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, flac_bytes long, flac_sha256 string"
    return pcm.mapInArrow(_features, schema)
