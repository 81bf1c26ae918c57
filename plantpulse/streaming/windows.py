"""Decay risk as event-time windows in the stream's state.

Points fade linearly over W minutes, so risk at minute t is
((W - t) * sum(p) + sum(p * m)) / W over the anomalies of the last W minutes: two sums
that merge.  Windows of W minutes that slide by one hold them, and for
each type its count and first minute, so a window's state is a few numbers and
no history is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.config import RiskOptions
from plantpulse.functions.columns import half_even_score, minute_number
from plantpulse.operators import risk
from plantpulse.sources import sinks

MINUTE = ["asset_id", "minute_ts"]


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")


def window_risk(anomalies: DataFrame, minutes: DataFrame | None = None, options: RiskOptions = RiskOptions(), watermark: str | None = None) -> DataFrame:
    """Risk at the last minute of each sliding window, for streams and tables.

    ``anomalies``: asset_id, minute_ts, anomaly_type, severity.  With ``minutes``
    (asset_id, minute_ts) these are scored, also where nothing fired; without,
    the minutes that have anomalies are.  Rows later than ``watermark`` don't count.
    An unknown type has points and no part in mode or drivers.
    """
    none = F.lit(None)
    rows = anomalies.select("asset_id", "minute_ts", "anomaly_type", risk.points(options).cast("bigint").alias("p"), F.lit(minutes is None).alias("asked"))
    if minutes is not None:
        rows = rows.unionByName(minutes.select("asset_id", "minute_ts", none.cast("string").alias("anomaly_type"), F.lit(0).cast("bigint").alias("p"), F.lit(True).alias("asked")))
    if watermark:
        rows = rows.withWatermark("minute_ts", watermark)
    width = options.window_minutes
    m, kind = minute_number(F.col("minute_ts")), F.col("anomaly_type")
    aggs = {"__asked": F.max((m == minute_number(F.col("w.end")) - 1) & F.col("asked")), "__p": F.sum("p"), "__pm": F.sum(F.col("p") * m)}
    for t in risk.TYPES:
        aggs[f"__n_{t}"] = _sum_if(kind == t, F.lit(1))
        aggs[f"__first_{t}"] = F.min(F.when(kind == t, m))
    held = rows.withColumn("w", F.window("minute_ts", f"{width} minutes", "1 minute")).groupBy("asset_id", "w").agg(*[a.alias(n) for n, a in aggs.items()])
    t = minute_number(F.col("w.end")) - 1
    score = half_even_score(((width - t) * F.col("__p") + F.col("__pm")) / width).cast("int")
    level = F.when(F.col("risk_score") <= options.low_max, "LOW").when(F.col("risk_score") <= options.med_max, "MED").otherwise("HIGH")
    seen = F.filter(F.array(*[F.struct((-F.col(f"__n_{x}")).alias("less"), F.col(f"__first_{x}").alias("first"), F.lit(x).alias("name")) for x in risk.TYPES]), lambda s: s["less"] < 0)
    top = F.concat_ws(", ", F.transform(F.slice(F.array_sort(seen), 1, 3), lambda s: F.concat(s["name"], F.lit("x"), (-s["less"]).cast("string"))))
    out = held.filter("__asked").withColumn("risk_score", score)
    return out.select("asset_id", (F.col("w.end") - F.expr("interval 1 minute")).alias("minute_ts"), "risk_score", level.alias("risk_level"), risk.failure_mode(lambda x: F.col(f"__n_{x}") > 0).alias("failure_mode"), top.alias("top_drivers"))


def start_window_risk(anomalies: DataFrame, path: str, checkpoint: str, minutes: DataFrame | None = None, options: RiskOptions = RiskOptions(), watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """The windows that each batch changes, in a folder a batch; a batch that is
    run again replaces its folder.  ``read_window_risk`` is the table."""
    changed = window_risk(anomalies, minutes, options, watermark)
    return changed.writeStream.foreachBatch(lambda batch, batch_id: sinks.append_batch(batch, path, batch_id)).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def read_window_risk(spark: SparkSession, path: str) -> DataFrame:
    return sinks.read_newest(spark, path, MINUTE)
