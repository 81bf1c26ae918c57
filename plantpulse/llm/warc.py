"""WARC archives of pages, and the assembly of their transactions.

A page is one capture: a request record, a response (or revisit) record and a
metadata record, the first and last naming the second in WARC-Concurrent-To.
Each record is a gzip member of its own.  Reading yields flat records;
``transactions`` joins those of a capture through the concurrent-to
identifiers into one nested row.

Every task writes a file of its own name; the manifest, a table written by
Spark, lists the files of the tasks that succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch, textbuf

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 1000
#: Copies of each repeated payload's digest in the join with the pages.
COPIES = 8
RECORDS = (
    "file string, position long, type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, payload_sha1 string, fields map<string,string>, payload binary"
)


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return zlib.compress(head + block + b"\r\n\r\n", 4, 31)


def _one_line(text: str | None) -> str | None:
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def response_id(page_id, digest: str) -> str:
    """The identifier of a response that revisits may name."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"capture:{page_id}:{digest}"))


def _capture(page_id, url, html: str | None, refers_to, used: set[str]) -> list[bytes]:
    payload = (html or "").encode()
    sha1 = hashlib.sha1(payload)
    digest = f"sha1:{base64.b32encode(sha1.digest()).decode()}"
    url = _one_line(url)
    parts = urlsplit(url or "") if url and "[" not in url else urlsplit("")
    own = response_id(page_id, sha1.hexdigest())
    if refers_to is not None or own in used:
        own = str(uuid.uuid4())
    used.add(own)
    own_ref = f"<urn:uuid:{own}>"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    request = f"GET {path} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        main = _record("response", own, shared, http + payload)
    else:
        named = response_id(refers_to, sha1.hexdigest())
        main = _record("revisit", own, [*shared, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{named}>")], http)
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        _record("request", str(uuid.uuid4()), [("WARC-Target-URI", url), ("WARC-Concurrent-To", own_ref), ("Content-Type", "application/http; msgtype=request")], request),
        main,
        _record("metadata", str(uuid.uuid4()), [("WARC-Target-URI", url), ("WARC-Concurrent-To", own_ref), ("Content-Type", "application/warc-fields")], fields),
    ]


def _write(folder: str):
    def run(batches):
        fs, where = pafs.FileSystem.from_uri(folder)
        out, used, n = None, set(), 0
        for b in textbuf.slices(batches, "html"):
            if out is None:
                fs.create_dir(where, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{where}/{name}", compression=None)
                out.write(_record("warcinfo", str(uuid.uuid4()), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                out.write(b"".join(_capture(*row, used)))
                n += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([n])], ["path", "captures"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; the manifest (path, captures).

    Of pages with equal payloads of at least 1000 bytes the one with the
    largest id is stored and the others revisit it.  Null html is an empty
    payload; a null url leaves the target out; rows without an id are stored
    whole and take no part in revisits; rows that repeat the largest id are
    all responses.  An empty table gives an empty manifest.
    """
    root = scratch.root(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha1"))
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    # a payload of very many pages is one key: pages are dealt over several copies of it
    large = large.select("sha1", "last", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("dealt"))
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    dealt = F.pmod(F.xxhash64("page_id"), F.lit(COPIES)).cast("int")
    placed = rows.withColumn("dealt", dealt).join(large, ["sha1", "dealt"], "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return scratch.stored(placed.mapInArrow(_write(f"{root}/warc"), "path string, captures long"), f"{root}/manifest")


# ---- reading ---------------------------------------------------------------


def members(f, chunk: int = 1 << 20):
    """(offset, bytes) of each gzip member of a file."""
    data, at, begin, eof = b"", 0, 0, False
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at == len(data):
                data, at = f.read(chunk), 0
                if not data:
                    if out:
                        raise ValueError("an archive ends inside a record")
                    eof = True
                    break
            piece = data if at == 0 else data[at:]
            out.append(z.decompress(piece))
            left = len(z.unused_data)
            used = len(piece) - left
            at, begin = at + used, begin + used
        if eof:
            return
        yield begin, b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than its length")
    return headers, rest[:size]


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>").removeprefix("urn:uuid:")


def _hex_digest(value: str | None) -> str | None:
    if value is None:
        return None
    text = value.partition(":")[2]
    return base64.b32decode(text).hex() if len(text) == 32 else text.lower()


def _read(with_payload: bool):
    names = [c.strip().split(" ")[0] for c in RECORDS.split(", ")]
    schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def batch(rows):
        return pa.record_batch([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], names)

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, where = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(where, compression=None) as f:
                    for position, raw in members(f):
                        h, block = parse_record(raw)
                        kind = h.get("warc-type")
                        payload, fields = None, None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                        elif h.get("content-type") == "application/warc-fields":
                            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().splitlines()) if k]
                        rows.append((
                            path, position, kind, _bare(h.get("warc-record-id")), _bare(h.get("warc-concurrent-to")), _bare(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-date"),
                            _hex_digest(h.get("warc-payload-digest")), None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), fields, payload if with_payload else None,
                        ))
                        size += len(block)
                        if len(rows) >= 1000 or size > 4_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all files in a manifest's ``path`` column, a task a file."""
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(_read(with_payload), RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: file, capture_id, request, response, metadata.

    Records of a file that name the same response or revisit in
    WARC-Concurrent-To belong to it.  A missing record is a null struct.
    """
    part = F.struct("type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload_sha1", "payload", "position")
    meta = F.struct("record_id", "fields", "position")
    of = lambda *kinds: F.col("type").isin(*kinds)
    return (
        records.filter(of("request", "response", "revisit", "metadata"))
        .withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("file", "capture_id")
        .agg(
            F.first(F.when(of("request"), part), ignorenulls=True).alias("request"),
            F.first(F.when(of("response", "revisit"), part), ignorenulls=True).alias("response"),
            F.first(F.when(of("metadata"), meta), ignorenulls=True).alias("metadata"),
        )
    )


def captures(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back and describe every capture.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri;
    a revisit's payload is that of the response it names, which must carry the
    same digest.
    """
    found = transactions(read_records(write_archives(pages), with_payload=False))
    flat = found.select(
        F.col("metadata.fields").getItem("page-id").cast("long").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("named"),
        F.col("response.payload_bytes").alias("bytes"), F.coalesce("response.payload_sha1", "response.payload_digest").alias("payload_digest"), F.col("response.target_uri").alias("target_uri"),
    )
    flat = scratch.stored(flat, scratch.root(pages.sparkSession) + "/captures")
    named = flat.filter("named is not null").select(F.col("named").alias("record_id")).distinct()
    originals = flat.join(named, "record_id").groupBy(F.col("record_id").alias("named"), "payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("full_bytes"))
    return flat.join(originals, ["named", "payload_digest"], "left").select("page_id", F.coalesce("bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri")
