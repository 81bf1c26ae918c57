"""Bounded-lookback windows over long histories without one task per asset.

An asset's rows are cut into chunks of time; a chunk also carries the rows of
the lookback before it, marked as carried.  Frames that look back no further
see the same rows as over the whole history, and the window's partitions are
bounded by chunk length instead of history length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SECONDS = 86_400


def in_chunks(df: DataFrame, epoch: str, lookback_seconds: int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Adds ``__chunk`` and ``__carried``; carried rows are copies for the lookback."""
    if lookback_seconds > chunk_seconds:
        raise ValueError("the lookback must fit one chunk")
    chunk = F.floor(F.col(epoch) / chunk_seconds).cast("bigint")
    ahead = F.col(epoch) >= (chunk + 1) * chunk_seconds - lookback_seconds
    places = F.when(ahead, F.array(F.struct(chunk.alias("c"), F.lit(False).alias("k")), F.struct((chunk + 1).alias("c"), F.lit(True).alias("k")))).otherwise(F.array(F.struct(chunk.alias("c"), F.lit(False).alias("k"))))
    return df.withColumn("__place", F.explode(places)).withColumns({"__chunk": F.col("__place.c"), "__carried": F.col("__place.k")}).drop("__place")


def own(df: DataFrame) -> DataFrame:
    """Only the rows of the chunks themselves."""
    return df.filter(~F.col("__carried")).drop("__chunk", "__carried")
