"""Batches that are published whole: rows first, then one record that names them.

A batch writes its rows into folders of its own.  They count once the record of
the next version stands, one row in one file that appears by a rename: it lists the folders
of every table by day or bucket, and holds the consumer's mark and
the last batch it took in.  So tables, states and mark change together or not at all,
and a batch that is run again finds itself done.

Two kinds of tables:

* **Changes** (by day): each version adds the rows it made for some keys, and a
  deletion mark for keys it looked at that have no row any more.  Of a key only
  the newest version counts.  A day of many versions is merged into one folder,
  marks of newest versions included.
* **States** (by bucket of the key's hash): a version replaces the buckets that
  hold changed keys; others are not read or written.

Folders that a version replaced are removed ``KEEP`` versions later.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantpulse.sources import sinks

#: Versions after which what a version replaced is removed.
KEEP = 2
#: Versions of a day that are merged into one folder.
MERGE = 24
BUCKETS = 64
RECORD = "last timestamp, record string"


def bucket(keys: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _newest(spark: SparkSession, base: str, consumer: str) -> dict:
    path = f"{base}/marks/consumer={consumer}"
    empty = {"version": 0, "batch": -1, "tables": {}, "schemas": {}, "replaced": [], "last": None}
    if not sinks.has_folder(spark, path):
        return empty
    found = spark.read.schema(f"{RECORD}, v long").parquet(path).agg(F.max_by(F.struct("last", "record"), "v").alias("r")).first()["r"]
    return empty if found is None else json.loads(found["record"]) | {"last": found["last"]}


def folders(spark: SparkSession, base: str, consumer: str, name: str) -> dict[str, list[str]]:
    """The published folders of a table by day or bucket."""
    return _newest(spark, base, consumer)["tables"].get(name, {})


def _last_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("__top", F.max("version").over(W.partitionBy(*keys))).filter(F.col("version") == F.col("__top")).drop("__top")


def settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Changes as a table: rows of each key's newest version, without marks."""
    return _last_versions(rows, keys).filter(~F.col("deleted"))


class Batch:
    """What one batch of one consumer writes; nothing counts before ``publish``."""

    def __init__(self, spark: SparkSession, base: str, consumer: str, batch_id: int):
        self.spark, self.base, self.consumer, self.batch_id = spark, base, consumer, batch_id
        before = _newest(spark, base, consumer)
        self.taken = before["batch"]
        self.done = self.taken >= batch_id
        self.last, self.version = before["last"], before["version"] + 1
        self.tables, self.schemas = before["tables"], before["schemas"]
        self.replaced: list[str] = []

    def read(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table as it stands with this batch, or some of its days or buckets."""
        held = self.tables.get(name, {})
        paths = [f"{self.base}/{name}/{p}" for part in (held if parts is None else parts) for p in held.get(part, [])]
        if name not in self.schemas:
            return None
        schema = StructType.fromJson(self.schemas[name])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def parts_since(self, name: str, version: int) -> list[str]:
        """The days or buckets with rows of versions after this one."""
        number = lambda folder: int(folder.split("/")[0].split("=")[1])
        return [part for part, held in self.tables.get(name, {}).items() if any(number(f) > version for f in held)]

    def _write(self, name: str, rows: DataFrame, by: str, folder: str) -> dict[str, str]:
        path = f"{self.base}/{name}/{folder}"
        rows.write.mode("overwrite").partitionBy(by).parquet(path)
        self.schemas[name] = json.loads(rows.drop(by).schema.json())
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in sinks.folder_names(self.spark, path) if n.startswith(f"{by}=")}

    def change(self, name: str, rows: DataFrame, redone: DataFrame, keys: list[str], ts: str = "minute_ts") -> None:
        """Rows that this batch made, of those whose keys ``redone`` has (with
        ``ts``); keys without a row get a deletion mark."""
        rest = [c for c in rows.columns if c not in redone.columns]
        both = redone.join(rows.withColumn("deleted", F.lit(False)), redone.columns, "left").select(*redone.columns, *rest, F.coalesce("deleted", F.lit(True)).alias("deleted"))
        self._add(name, both.select(*rows.columns, "deleted"), keys, ts)

    def append(self, name: str, rows: DataFrame, keys: list[str], ts: str = "minute_ts") -> None:
        """Rows that are new or take the place of all rows of their keys."""
        self._add(name, rows.withColumn("deleted", F.lit(False)), keys, ts)

    def _add(self, name: str, rows: DataFrame, keys: list[str], ts: str) -> None:
        both = rows.withColumns({"version": F.lit(self.version).cast("long"), "event_date": F.to_date(ts)})
        for day, folder in self._write(name, both, "event_date", f"v={self.version}").items():
            self.tables.setdefault(name, {}).setdefault(day, []).append(folder)
        crowded = [day for day, held in self.tables.get(name, {}).items() if len(held) >= MERGE]
        if crowded:
            merged = _last_versions(self.read(name, crowded), keys).withColumn("event_date", F.to_date(ts))
            self._replace(name, self._write(name, merged, "event_date", f"merged={self.version}"), crowded)

    def _replace(self, name: str, written: dict[str, str], parts: list[str]) -> None:
        held = self.tables.setdefault(name, {})
        for part in parts:
            self.replaced += [f"{name}/{p}" for p in held.pop(part, [])]
            if part in written:
                held[part] = [written[part]]

    def put(self, name: str, rows: DataFrame, touched: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """States: ``rows`` in the place of all rows whose keys ``touched`` has."""
        hit = touched.select(*keys).distinct()
        # numbers below ``buckets``, whatever the keys
        parts = sorted(str(r["b"]) for r in hit.select(bucket(keys, buckets).alias("b")).distinct().collect())
        if not parts:
            return
        before = self.read(name, parts)
        kept = rows if before is None else before.join(hit, keys, "left_anti").unionByName(rows)
        self._replace(name, self._write(name, kept.withColumn("bucket", bucket(keys, buckets)), "bucket", f"v={self.version}"), parts)

    def states(self, name: str, touched: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame | None:
        """The rows of these keys, from their buckets alone."""
        hit = touched.select(*keys).distinct()
        parts = [str(r["b"]) for r in hit.select(bucket(keys, buckets).alias("b")).distinct().collect()]
        found = self.read(name, parts)
        return None if found is None else found.join(hit, keys, "left_semi")

    def publish(self, last=None) -> None:
        """Make everything count at once; ``last`` is the consumer's mark."""
        record = {"version": self.version, "batch": self.batch_id, "tables": self.tables, "schemas": self.schemas, "replaced": self.replaced}
        row = self.spark.createDataFrame([(self.last if last is None else last, json.dumps(record))], RECORD)
        path = f"{self.base}/marks/consumer={self.consumer}"
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/v={self.version}")
        old = f"{path}/v={self.version - KEEP}"
        if sinks.has_folder(self.spark, old):
            for r in self.spark.read.schema(RECORD).parquet(old).collect():
                for folder in json.loads(r["record"])["replaced"]:
                    sinks.drop_folder(self.spark, f"{self.base}/{folder}")
            sinks.drop_folder(self.spark, old)


def read(spark: SparkSession, base: str, consumer: str, name: str, parts: list[str] | None = None) -> DataFrame | None:
    """A published table, or some of its days or buckets; None before its first rows."""
    return Batch(spark, base, consumer, -1).read(name, parts)
