"""The analytics stream with its fan-out; the consumers behind it are in ``chain``.

A batch writes its rows of each table into folders of its own and the current
states as a new version, so a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plantpulse.operators import detect, facts, features, risk
from plantpulse.sources import sinks, telemetry
from plantpulse.streaming import jobs
from plantpulse.streaming.chain import FACT, MINUTE, chain_table, start_chain

__all__ = ["FACT", "KEYS", "chain_table", "run_whole_plant", "start_analytics", "start_chain", "supervise"]
#: Minute tables of the chain behind this stream.
KEYS = {"features": MINUTE, "anomalies": MINUTE, "risk": MINUTE}


def start_analytics(events: DataFrame, profiles: DataFrame, base: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Closed minutes, joined with the profiles in the stream, to five tables
    (facts, enriched, features, anomalies, risk) and the current states."""
    enriched = facts.enrich(facts.minute_facts(events, watermark), profiles)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            minute, scored = batch.select(*FACT), risk.threshold_risk(batch)
            tables = {"facts": minute, "enriched": batch, "features": features.features_minimal(minute), "anomalies": detect.threshold_anomalies(minute), "risk": scored}
            for name, rows in tables.items():
                sinks.append_batch(rows, f"{base}/{name}", batch_id)
            sinks.upsert_version(risk.current_risk(scored), f"{base}/current", batch_id, ["asset_id"], "as_of_minute_ts")
        finally:
            batch.unpersist()

    return enriched.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def run_whole_plant(spark: SparkSession, raw: DataFrame, profiles: DataFrame, base: str, min_events: int = 5, trigger: dict | None = None) -> list[StreamingQuery]:
    """All streams of the plant from one source: the raw archive, closed minutes
    by day, the analytics fan-out, and the chain behind the minutes."""
    events = telemetry.parse_events(raw)
    found = jobs.run_plant(spark, raw, base, trigger)
    found.append(start_analytics(events, profiles, f"{base}/analytics", f"{base}/checkpoints/analytics", trigger=trigger))
    found.append(start_chain(spark, f"{base}/asset_minute_fact", f"{base}/chain", f"{base}/checkpoints/chain", min_events, trigger))
    return found


def supervise(queries: list[StreamingQuery], poll_seconds: float = 5.0) -> None:
    """Wait until all streams have ended; if one fails, stop the others and raise."""
    left = list(queries)
    try:
        while left:
            left = [q for q in left if not q.awaitTermination(poll_seconds)]
    finally:
        for q in left:
            q.stop()
