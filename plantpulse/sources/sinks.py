"""Sinks: appends and upserts that a replayed batch doesn't change.

Plain ``append_table`` and ``jdbc_write`` are the exceptions; see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Make a database, in the warehouse or in a folder of its own."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))


def jdbc_write(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Credentials come with the options; none are kept here.  A repeated append
    doubles rows unless the table's key refuses them."""
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**options).save()


def jdbc_append_batch(df: DataFrame, url: str, table: str, stream: str, batch_id: int, **options: str) -> None:
    """Append a stream's batch so that a repeated one replaces its rows.

    Rows carry ``stream_name`` and ``batch_id``; what an earlier attempt left is
    deleted first, whole or in part.  The first write creates the table.
    """
    spark = df.sparkSession
    if options.get("driver"):
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, str(v))
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        found = connection.getMetaData().getTables(None, None, "%", None)
        there = False
        while found.next():
            there = there or found.getString("TABLE_NAME").upper() == table.split(".")[-1].upper()
        if there:
            statement = connection.prepareStatement(f"DELETE FROM {table} WHERE CAST(stream_name AS VARCHAR(128)) = ? AND batch_id = ?")
            statement.setString(1, stream)
            statement.setLong(2, int(batch_id))
            statement.executeUpdate()
    finally:
        connection.close()
    rows = df.withColumns({"stream_name": F.lit(stream), "batch_id": F.lit(int(batch_id)).cast("long")})
    jdbc_write(rows.toDF(*[c.upper() for c in rows.columns]), url, table, **options)


def to_jdbc(url: str, table: str, stream: str, **options: str):
    """What ``start_raw(also=...)`` takes to write its batches to a database too."""
    return lambda batch, batch_id: jdbc_append_batch(batch, url, table, stream, batch_id, **options)


def append_table(df: DataFrame, table: str, ts: str = "minute_ts", batch: tuple[str, int] | None = None) -> None:
    """Append to a managed Parquet table by day; the first write creates it.

    With ``batch`` (stream, number) the rows go to partitions of that batch, and
    the ledger beside the table names it last.  The same batch again replaces
    its rows, on whatever days they were; ``read_appended`` shows only batches
    of the ledger, so an append that failed half-way isn't seen.  A table takes
    appends of one kind.
    """
    rows = df.withColumn("event_date", F.to_date(ts))
    if batch is None:
        rows.write.mode("append").format("parquet").partitionBy("event_date").saveAsTable(table)
        return
    spark, (stream, number) = df.sparkSession, batch
    if spark.catalog.tableExists(table):
        held = spark.sql(f"SHOW PARTITIONS {table} PARTITION (stream = :stream, batch_id = {int(number)})", {"stream": stream})
        for r in held.collect():  # a row a day of this batch
            day = r["partition"].split("/")[0].split("=")[1]
            spark.sql(f"ALTER TABLE {table} DROP PARTITION (event_date = :day, stream = :stream, batch_id = {int(number)})", {"day": day, "stream": stream})
    rows.withColumns({"stream": F.lit(stream), "batch_id": F.lit(int(number)).cast("long")}).write.mode("append").format("parquet").partitionBy("event_date", "stream", "batch_id").saveAsTable(table)
    entry = spark.createDataFrame([(stream, int(number))], "stream string, batch_id long")
    if spark.catalog.tableExists(f"{table}_ledger"):
        entry = entry.join(spark.table(f"{table}_ledger"), ["stream", "batch_id"], "left_anti")
    entry.write.mode("append").format("parquet").saveAsTable(f"{table}_ledger")


def read_appended(spark: SparkSession, table: str) -> DataFrame:
    """The rows of the batches that the table's ledger names."""
    return spark.table(table).join(spark.table(f"{table}_ledger"), ["stream", "batch_id"], "left_semi")


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A batch's own folder: writing the same batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def insert_new(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows whose key is not there yet; of several of one key the
    least by its other columns, so that a replay takes the same."""
    once = batch.groupBy(*keys).agg(F.min(F.struct(*[c for c in batch.columns if c not in keys])).alias("__r"))
    once = once.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in batch.columns]) if len(batch.columns) > len(keys) else batch.distinct()
    return once.join(existing.select(*keys), keys, "left_anti")


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the greatest ``order``.

    An aggregate of structs, so hot keys combine before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.col(order)).alias("r"))
    return top.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Existing rows with the updates' rows in the place of equal keys.

    With ``order`` an update replaces only an older row, and of several
    updates of a key the newest counts, so late batches don't turn time back.
    Without it the greatest of several updates by all columns counts.
    """
    if order is None:
        once = newest(updates.withColumn("__all", F.struct(*updates.columns)), keys, "__all").select(*updates.columns)
        return existing.join(once.select(*keys), keys, "left_anti").unionByName(once)
    return newest(existing.unionByName(updates), keys, order)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a new version beside those being read; the path to switch to."""
    path = f"{base}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def has_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def upsert_version(batch: DataFrame, base: str, version: int, keys: list[str], order: str) -> str:
    """The next version of a table of states: the one before with newer rows.

    The whole table is written; two versions stay.  For a large table use
    ``commits.Batch.put``, which writes the buckets of changed keys.
    """
    spark = batch.sparkSession
    table = upsert(spark.read.parquet(f"{base}/v={version - 1}"), batch, keys, order) if version else newest(batch, keys, order)
    path = write_version(table, base, version)
    if version > 1:
        drop_folder(spark, f"{base}/v={version - 2}")
    return path


def read_version(spark: SparkSession, base: str, version: int, schema: str) -> DataFrame:
    """A version of a table; without any (before the first) an empty one."""
    return spark.read.schema(schema).parquet(f"{base}/v={version}") if version >= 0 else spark.createDataFrame([], schema)


def keep_version(spark: SparkSession, base: str, version: int, schema: str) -> str:
    """Carry the version before on without a change."""
    return write_version(read_version(spark, base, version - 1, schema), base, version)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``append_batch`` wrote, with ``batch_id``."""
    return spark.read.parquet(path)


def read_newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A table whose batches hold changed rows only: the last row of each key."""
    return newest(read_batches(spark, path), keys, "batch_id").drop("batch_id")


def save_mark(mark: DataFrame, base: str, consumer: str, version: int) -> None:
    """Store how far a consumer has come: ``mark`` is one row with ``last``."""
    mark.select("last").write.mode("overwrite").parquet(f"{base}/consumer={consumer}/v={version}")


def load_mark(spark: SparkSession, base: str, consumer: str, default=None):
    """The newest mark of a consumer, or ``default`` before its first."""
    path = f"{base}/consumer={consumer}"
    if not has_folder(spark, path):
        return default
    found = spark.read.parquet(path).agg(F.max_by("last", "v").alias("last")).first()["last"]
    return default if found is None else found


def latest_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by a full order (ties broken by the order)."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
