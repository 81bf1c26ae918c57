"""Late events counted exactly, although the engine drops them unseen.

What arrives in a batch is an observed metric of the stream; a listener writes
it to a table.  What a batch accepts is the growth of the event counts of the
minutes it changed, published with these minutes.  The difference came too late.
(The engine's own count is of partial groups, not of events.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from plantpulse.operators import facts
from plantpulse.sources import commits, sinks
from plantpulse.streaming import chain

METRIC = "arrivals"
ARRIVED = "n_events long, newest timestamp"


class Arrivals(StreamingQueryListener):
    """Writes each batch's observed arrivals to ``path``, a folder a batch, so a
    batch that is run again replaces its row.  One listener for one stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(METRIC)
        if seen is not None and seen["path"] == self.path:
            row = self.spark.createDataFrame([(seen["n_events"], seen["newest"])], ARRIVED)
            sinks.append_batch(row.coalesce(1), self.path, event.progress.batchId)

    def onQueryTerminated(self, event) -> None:
        pass


def publish_counted(spark: SparkSession, base: str, batch_id: int, minutes: DataFrame) -> None:
    """Minute facts that changed, and how many events they gained."""
    batch = commits.Batch(spark, base, "facts", batch_id)
    if batch.done:
        return
    rows = minutes.select(*chain.FACT).persist()
    try:
        days = [str(r["d"]) for r in rows.select(F.to_date("minute_ts").alias("d")).distinct().collect()]
        before = batch.read("facts", days)
        gained = rows.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("n"), F.max("minute_ts").alias("last")).first()
        had = 0
        if before is not None:
            had = commits.settled(before, chain.MINUTE).join(rows.select(*chain.MINUTE), chain.MINUTE, "left_semi").agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("n")).first()["n"]
        batch.append("facts", rows, chain.MINUTE)
        row = spark.createDataFrame([(batch_id, gained["n"] - had)], "batch_id long, n_accepted long")
        batch.put("accepted", row, row, ["batch_id"])
        last = gained["last"]
        batch.publish(last if batch.last is None else batch.last if last is None else max(last, batch.last))
    finally:
        rows.unpersist()


def start_counted_facts(events: DataFrame, base: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> tuple[StreamingQuery, Arrivals]:
    """Minutes that changed, published for consumers to follow, with late events
    counted.  Remove the listener when the stream has ended and its last
    progress is in (``late_counts`` tells)."""
    spark, path = events.sparkSession, f"{base}/arrivals"
    listener = Arrivals(spark, path)
    spark.streams.addListener(listener)
    observed = events.observe(METRIC, F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("newest"), F.max(F.lit(path)).alias("path"))
    changed = facts.minute_facts(observed, watermark)
    query = changed.writeStream.foreachBatch(lambda batch, batch_id: publish_counted(batch.sparkSession, base, batch_id, batch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    return query, listener


def late_counts(spark: SparkSession, base: str) -> DataFrame:
    """batch_id, n_events, n_accepted, n_late of the batches with arrivals."""
    arrived = spark.read.schema(f"{ARRIVED}, batch_id long").parquet(f"{base}/arrivals").filter("n_events > 0")
    taken = commits.read(spark, base, "facts", "accepted")
    joined = arrived.join(taken, "batch_id", "left").withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0)))
    return joined.select("batch_id", "n_events", "n_accepted", (F.col("n_events") - F.col("n_accepted")).alias("n_late"))


def await_arrivals(spark: SparkSession, query: StreamingQuery, listener: Arrivals, seconds: float = 60.0) -> None:
    """Wait until the listener has the ended stream's last batch, then remove it."""
    import time

    last = query.lastProgress
    end = time.monotonic() + seconds
    while last is not None and METRIC in last.observedMetrics and not sinks.has_folder(spark, f"{listener.path}/batch_id={last.batchId}/_SUCCESS") and time.monotonic() < end:
        time.sleep(0.1)
    spark.streams.removeListener(listener)
