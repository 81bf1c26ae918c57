"""Serving tables in the order of their pages, for top-k and keyset reads.

Rows are range-partitioned and sorted by the page order into numbered pages, and
an index holds each page's first and last key and its rows.  A read takes the few pages that
hold what it wants, as a partition filter: other files are not opened, however
large the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An order: columns, those with a minus falling; together they name one row.
Order = tuple[str, ...]


def _names(order: Order) -> list[str]:
    return [c.lstrip("-") for c in order]


def _sorting(order: Order) -> list[Column]:
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in order]


def after(order: Order, key: tuple, prefix: str = "") -> Column:
    """Whether a row comes after the row with this key; keys hold no nulls."""
    out = F.lit(False)
    for c, value in reversed(list(zip(order, key))):
        x = F.col(prefix + c.lstrip("-"))
        further = x < F.lit(value) if c.startswith("-") else x > F.lit(value)
        out = further | ((x == F.lit(value)) & out)
    return out


def write_pages(df: DataFrame, path: str, order: Order, rows: int = 1_000_000) -> None:
    """Store ``df`` as pages of about ``rows`` rows, sorted by ``order``, with their index."""
    n = max(1, -(-df.count() // rows))
    placed = df.repartitionByRange(n, *_sorting(order)).sortWithinPartitions(*_sorting(order)).withColumn("place", F.monotonically_increasing_id()).withColumn("page", F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy("page").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    key = F.struct(*_names(order))
    stored.groupBy("page").agg(F.count("*").alias("n"), F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last")).write.mode("overwrite").parquet(f"{path}/index")


def pages_of(spark: SparkSession, path: str, order: Order, take: int, key: tuple | None = None) -> list[int]:
    """The pages that hold the next ``take`` rows after ``key``, from the index alone.

    The first of them may lie partly before the key, so its rows don't count.
    """
    index = spark.read.parquet(f"{path}/index")
    if key is not None:
        index = index.filter(after(order, key, "last."))
    held, found = 0, []
    for r in index.orderBy("page").limit(take + 1).collect():  # every page has a row
        if held >= take:
            break
        found.append(r["page"])
        if key is None or len(found) > 1:
            held += r["n"]
    return found


def read_page(spark: SparkSession, path: str, order: Order, take: int, key: tuple | None = None) -> DataFrame:
    """The next ``take`` rows in the order, after the row with this key."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/rows").filter(F.col("page").isin(pages_of(spark, path, order, take, key)))
    if key is not None:
        rows = rows.filter(after(order, key))
    return rows.drop("place", "page").orderBy(*_sorting(order)).limit(take)
