"""The two streams of the plant, and the chain that follows new facts.

Sinks are idempotent and failures are not swallowed: a batch that fails is
run again from the checkpoint and changes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.config import DEPLOYED_HYBRID, HybridThresholds, RiskOptions
from plantpulse.operators import detect, facts, features, risk
from plantpulse.sources import sinks, telemetry

#: How far a corrected minute reaches: rolling features, lookback, risk window.
REACH_MINUTES = 59 + 10 + 29


def start_raw(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Archive parsed events; ``also`` may write each batch elsewhere too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sinks.append_batch(batch, path, batch_id)
            if also:
                also(batch, batch_id)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_facts(events: DataFrame, path: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Final minute facts by day: a minute is written once, when the watermark closes it."""
    final = facts.minute_facts(events, watermark).withColumn("event_date", F.to_date("minute_ts"))
    return final.writeStream.format("parquet").outputMode("append").partitionBy("event_date").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def start_fact_upserts(events: DataFrame, base: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Early minute facts: each batch upserts the minutes that changed.

    Versions are folders of their own; the newest holds the whole table, and
    those older than the one before it are removed.  For a table too large to
    be written anew each time use ``start_fact_changes``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{base}/v={batch_id - 1}"
        table = sinks.upsert(spark.read.parquet(before), batch, ["asset_id", "minute_ts"]) if batch_id else batch
        sinks.write_version(table, base, batch_id)
        if batch_id > 1:
            sinks.drop_folder(spark, f"{base}/v={batch_id - 2}")

    changed = facts.minute_facts(events, watermark)
    return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def start_fact_changes(events: DataFrame, path: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Early minute facts: each batch writes the minutes that changed, no more.

    ``sinks.read_newest(spark, path, ["asset_id", "minute_ts"])`` is the table.
    """
    changed = facts.minute_facts(events, watermark)
    return changed.writeStream.foreachBatch(lambda batch, batch_id: sinks.append_batch(batch, path, batch_id)).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def threshold_chain(minute: DataFrame, profiles: DataFrame) -> dict[str, DataFrame]:
    """All tables that follow from minute facts under the threshold policy."""
    enriched = facts.enrich(minute, profiles)
    scored = risk.threshold_risk(enriched)
    return {"enriched": enriched, "features": features.features_minimal(minute), "anomalies": detect.threshold_anomalies(minute), "risk": scored, "current": risk.current_risk(scored)}


def hybrid_chain(minute: DataFrame, min_events: int = 5, thresholds: HybridThresholds = DEPLOYED_HYBRID, options: RiskOptions = RiskOptions()) -> dict[str, DataFrame]:
    """All tables that follow from minute facts under the decay policy."""
    rolling = features.features_rolling(minute, min_events)
    found = detect.hybrid_anomalies(rolling, thresholds)
    scored = risk.decay_risk(found, options)
    return {"features": rolling, "anomalies": found, "risk": scored, "current": risk.current_risk(scored)}


def touched_history(history: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts to read, minutes to recompute) for a batch of changed minutes.

    A changed minute reaches ``REACH_MINUTES`` ahead, and recomputing needs as
    much history again before it.
    """
    span = changed.groupBy("asset_id").agg(F.min("minute_ts").alias("lo"), F.max("minute_ts").alias("hi"))
    reach = F.expr(f"interval {REACH_MINUTES} minutes")
    near = history.join(span, "asset_id")
    read = near.filter((F.col("minute_ts") >= F.col("lo") - reach) & (F.col("minute_ts") <= F.col("hi") + reach)).drop("lo", "hi")
    redo = near.filter((F.col("minute_ts") >= F.col("lo")) & (F.col("minute_ts") <= F.col("hi") + reach)).select("asset_id", "minute_ts")
    return read, redo


def recompute(history: DataFrame, changed: DataFrame, min_events: int = 5) -> dict[str, DataFrame]:
    """The hybrid chain's rows that a batch of changed minutes may alter."""
    read, redo = touched_history(history, changed)
    tables = hybrid_chain(read, min_events)
    return {name: tables[name].join(redo, ["asset_id", "minute_ts"], "left_semi") for name in ("features", "anomalies", "risk")}


def run_plant(spark: SparkSession, raw: DataFrame, base: str, trigger: dict | None = None) -> list[StreamingQuery]:
    """Both streams from one parsed source; stop them with ``query.stop()``."""
    events = telemetry.parse_events(raw)
    return [start_raw(events, f"{base}/telemetry_raw", f"{base}/checkpoints/raw", trigger), start_facts(events, f"{base}/asset_minute_fact", f"{base}/checkpoints/facts", trigger=trigger)]
