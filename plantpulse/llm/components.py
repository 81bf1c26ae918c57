"""Connected components of an edge table by label contraction.

Each round links every vertex to the least label around it and then halves
paths (label of label).  Rounds grow with the logarithm of the longest chain.
Every round is two aggregates of small rows and ends in a stored table, so
neither lineage nor the driver grows; hot vertices are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import scratch


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each vertex of the edges the least id reachable.

    Edges may repeat, point either way or join a vertex to itself.  Vertices
    without an edge are absent.  No edges give an empty table.
    """
    spark = edges.sparkSession
    root = scratch.root(spark)
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    state = scratch.stored(pairs, f"{root}/0")
    seen = _summary(state)
    for i in range(1, max_rounds + 1):
        # large star: neighbours above a vertex move to the least label around it
        both = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        # small star: a vertex and its smaller neighbours move to the least of them
        low = moved.groupBy("u").agg(F.min("v").alias("m"))
        after = scratch.stored(moved.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), f"{root}/{i}")
        if i > 1:
            scratch.drop(spark, f"{root}/{i - 1}")
        state, before, seen = after, seen, _summary(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _summary(edges: DataFrame):
    """Count and hash of an edge set: equal when nothing changed."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
