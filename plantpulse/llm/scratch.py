"""Tables that cut a job's lineage, in the folder the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.session import scratch_folder as root

__all__ = ["drop", "fresh", "root", "stored"]


def stored(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write the rows as Parquet and read them back."""
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where ``df`` has columns of theirs in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
