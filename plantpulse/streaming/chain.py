"""What follows from new minutes: features, anomalies, risk, states, advice, rollups.

A step takes the minutes that changed, reads the days they reach, redoes the
minutes in reach and publishes everything with its mark (see ``commits``):

* features, anomalies, risk and rollups as changes, so a minute that no longer
  fires loses its rows when a late one corrects it;
* the newest risk of each asset, and its active recommendations, as states by
  bucket; closed recommendations apart, by day.  Only assets whose risk changed
  are reconciled.

Steps come from a stream of files (``start_chain``) or from another consumer's
published facts, from the stored mark on (``follow``).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plantpulse import schemas
from plantpulse.config import DEPLOYED_HYBRID, SIGNALS, HybridThresholds, RiskOptions
from plantpulse.operators import detect, facts, features, recommend, risk
from plantpulse.plans import serving
from plantpulse.session import sized_caches
from plantpulse.sources import commits, sinks
from plantpulse.streaming import jobs

FACT = ["asset_id", "minute_ts", *SIGNALS.values(), "event_count", "fault_code_max"]
MINUTE = ["asset_id", "minute_ts"]
#: Tables of changes and the keys whose newest version counts.
KEYS = {"features": MINUTE, "anomalies": MINUTE, "risk": MINUTE, "rollups": ["asset_id", "step", "minute_ts"], "closed": ["recommendation_id"]}
ROLLUP_STEPS = (5, 15)
CURRENT = ["asset_id", "as_of_minute_ts", "risk_score", "risk_level", "failure_mode", "top_drivers", "evidence_json"]


def reach(changed: DataFrame) -> tuple[DataFrame, list[datetime.date], tuple] | None:
    """(spans of changed minutes by asset and day, days to read, time to read).

    A changed minute alters ``REACH_MINUTES`` after it, and redoing these needs
    as many before it.  The driver gets the touched days; None if there is no
    changed minute.
    """
    far = F.expr(f"interval {jobs.REACH_MINUTES} minutes")
    spans = changed.groupBy("asset_id", F.to_date("minute_ts").alias("day")).agg(F.min("minute_ts").alias("lo"), F.max("minute_ts").alias("hi"))
    days = spans.select(F.explode(F.sequence(F.to_date(F.col("lo") - far), F.to_date(F.col("hi") + far))).alias("day"), "lo", "hi")
    found = days.groupBy("day").agg(F.min(F.col("lo") - far).alias("lo"), F.max(F.col("hi") + far).alias("hi")).collect()
    if not found:
        return None
    return spans.drop("day"), sorted(r["day"] for r in found), (min(r["lo"] for r in found), max(r["hi"] for r in found))


#: Facts by the days to read: a scan that prunes, however long the history.
Facts = Callable[[list[datetime.date]], DataFrame]


def fact_files(spark: SparkSession, path: str, schema) -> Facts:
    """Facts in files; days are literal partition filters where there are days."""

    def read(days: list[datetime.date]) -> DataFrame:
        rows = spark.read.schema(schema).parquet(path)
        return rows.filter(F.col("event_date").isin(days)) if "event_date" in rows.columns else rows

    return read


def near(rows: DataFrame, spans: DataFrame, time: tuple) -> DataFrame:
    """The facts that a step reads: literal times reach the scan, then the spans
    cut exactly.  Of a minute in several batches the newest counts."""
    rows = rows.filter(F.col("minute_ts").between(F.lit(time[0]), F.lit(time[1])))
    rows = sinks.newest(rows.select(*FACT, "batch_id"), MINUTE, "batch_id") if "batch_id" in rows.columns else rows
    far = F.expr(f"interval {jobs.REACH_MINUTES} minutes")
    s = spans.select(F.col("asset_id").alias("__a"), "lo", "hi")
    return rows.select(*FACT).join(s, (F.col("asset_id") == F.col("__a")) & F.col("minute_ts").between(F.col("lo") - far, F.col("hi") + far), "left_semi")


def redone(read: DataFrame, spans: DataFrame) -> DataFrame:
    """The minutes that a step redoes, of those it read."""
    far = F.expr(f"interval {jobs.REACH_MINUTES} minutes")
    s = spans.select(F.col("asset_id").alias("__a"), "lo", "hi")
    return read.select(*MINUTE).join(s, (F.col("asset_id") == F.col("__a")) & F.col("minute_ts").between(F.col("lo"), F.col("hi") + far), "left_semi").distinct()


def _states(batch: commits.Batch, redo: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched assets, their newest risk): by this batch's rows and the states
    before; only an asset that lost its newest row looks through its history."""
    touched = redo.select("asset_id").distinct()
    new = risk.current_risk(scored.join(redo, MINUTE, "left_semi")).select(*CURRENT)
    before = batch.states("current", touched, ["asset_id"])
    if before is None:
        return touched, new
    again = redo.withColumnRenamed("minute_ts", "as_of_minute_ts")
    stays = before.join(again, ["asset_id", "as_of_minute_ts"], "left_anti")
    now = sinks.newest(stays.unionByName(new), ["asset_id"], "as_of_minute_ts")
    lost = before.select("asset_id").join(now.select("asset_id"), "asset_id", "left_anti").persist()
    if not lost.isEmpty():
        history = commits.settled(batch.read("risk"), MINUTE).join(lost, "asset_id", "left_semi")
        now = now.unionByName(risk.current_risk(history.drop("deleted", "version")).select(*CURRENT))
    return touched, now


def reconcile_changed(batch: commits.Batch, changed: DataFrame, now) -> None:
    """Recommendations of assets whose current risk changed.

    ``changed`` has their current rows.  Their active recommendations come from
    their buckets, and of the closed ones only those of the candidates' days,
    as a recommendation that was closed does not open again.
    """
    empty = batch.spark.createDataFrame([], schemas.RECOMMENDATIONS)
    active = batch.states("recommendations", changed, ["asset_id"])
    active = empty if active is None else active
    days = [str(r["d"]) for r in changed.select(F.to_date("as_of_minute_ts").alias("d")).distinct().collect()]
    closed = batch.read("closed", days)
    closed = empty if closed is None else commits.settled(closed, KEYS["closed"]).drop("deleted", "version").join(changed.select("asset_id"), "asset_id", "left_semi").select(*empty.columns)
    known = active.unionByName(closed).persist()
    after = recommend.reconcile(known, changed, now).persist()
    try:
        batch.put("recommendations", after.filter("status <> 'CLOSED'"), changed, ["asset_id"])
        were = known.filter("status = 'CLOSED'").select("recommendation_id")
        shut = after.filter("status = 'CLOSED'").join(were, "recommendation_id", "left_anti").select(*after.columns)
        batch.append("closed", shut, KEYS["closed"], "as_of_minute_ts")
    finally:
        after.unpersist()
        known.unpersist()


def roll_up(batch: commits.Batch, redo: DataFrame, days: list[str]) -> None:
    """The 5- and 15-minute risk of the buckets that hold redone minutes."""
    start = lambda step: F.window("minute_ts", f"{step} minutes")["start"]
    minutes = commits.settled(batch.read("risk", days), MINUTE)
    rows = keys = None
    for step in ROLLUP_STEPS:
        hit = redo.select("asset_id", start(step).alias("bucket")).distinct()
        these = minutes.withColumn("bucket", start(step)).join(hit, ["asset_id", "bucket"], "left_semi").drop("bucket")
        made = serving.risk_buckets(these, step).withColumn("step", F.lit(step))
        touched = hit.select("asset_id", F.lit(step).alias("step"), F.col("bucket").alias("minute_ts"))
        rows, keys = (made, touched) if rows is None else (rows.unionByName(made), keys.unionByName(touched))
    batch.change("rollups", rows, keys, KEYS["rollups"])


def step(batch: commits.Batch, source: Facts, changed: DataFrame, min_events: int = 5, thresholds: HybridThresholds = DEPLOYED_HYBRID, options: RiskOptions = RiskOptions()) -> None:
    """Redo what ``changed`` (asset_id, minute_ts) reaches and publish it.

    A batch that is published already changes nothing.
    """
    if batch.done:
        return
    with sized_caches(batch.spark, changed.sparkSession):
        changed = changed.select(*MINUTE).persist()
        held = [changed]
        try:
            found = reach(changed)
            if found is None:
                batch.publish()
                return
            spans, days, time = found
            last = changed.agg(F.max("minute_ts").alias("last")).first()["last"]
            last = last if batch.last is None else max(last, batch.last)
            read = near(source(days), spans, time).persist()
            redo = redone(read, spans).persist()
            rolling = features.features_rolling(read, min_events).persist()
            fired = detect.hybrid_anomalies(rolling, thresholds).persist()
            scored = risk.decay_risk(fired, options).persist()
            held += [read, redo, rolling, fired, scored]
            for name, rows in {"features": rolling, "anomalies": fired, "risk": scored}.items():
                batch.change(name, rows, redo, KEYS[name])
            roll_up(batch, redo, [str(d) for d in days])
            touched, current = _states(batch, redo, scored)
            current = current.persist()
            held.append(current)
            before = batch.states("current", touched, ["asset_id"])
            differs = (current if before is None else current.subtract(before.select(*CURRENT))).persist()
            held.append(differs)
            if not differs.isEmpty():
                reconcile_changed(batch, differs, last)
            batch.put("current", current, touched, ["asset_id"])
            batch.publish(last)
        finally:
            for df in held:
                df.unpersist()


def start_chain(spark: SparkSession, facts_path: str, base: str, checkpoint: str, min_events: int = 5, trigger: dict | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """The chain as a stream over the files of minute facts, present or to come."""
    sinks.make_folder(spark, facts_path)
    plain = StructType.fromDDL(schemas.FACTS)
    kept = spark.read.schema(plain).parquet(facts_path).schema  # with the days or batches of its folders
    reader = spark.readStream.schema(StructType([f for f in plain.fields if f.name in FACT]))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        step(commits.Batch(spark, base, "chain", batch_id), fact_files(spark, facts_path, kept if len(kept) > len(plain) else spark.read.schema(plain).parquet(facts_path).schema), batch.select(*FACT), min_events)

    return reader.parquet(facts_path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def chain_table(spark: SparkSession, base: str, name: str, days: list[str] | None = None) -> DataFrame:
    """A table of the chain as it stands, or some of its days: features, anomalies,
    risk, rollups, closed, or the states current and recommendations."""
    rows = commits.read(spark, base, "chain", name, days)
    if rows is None:
        raise ValueError(f"the chain has not published {name}")
    return commits.settled(rows, KEYS[name]).drop("deleted", "version") if name in KEYS else rows


# ---- consumers driven by marks ----------------------------------------------


def publish_facts(spark: SparkSession, base: str, batch_id: int, minutes: DataFrame, before_publishing: Callable[[], None] | None = None) -> None:
    """A batch of minute facts, new or corrected, with the newest minute as mark."""
    batch = commits.Batch(spark, base, "facts", batch_id)
    if batch.done:
        return
    with sized_caches(minutes.sparkSession):
        rows = minutes.select(*FACT).persist()
    try:
        batch.append("facts", rows, MINUTE)
        last = rows.agg(F.max("minute_ts").alias("last")).first()["last"]
        if before_publishing:
            before_publishing()
        batch.publish(last if batch.last is None else batch.last if last is None else max(last, batch.last))
    finally:
        rows.unpersist()


def start_published_facts(events: DataFrame, base: str, checkpoint: str, watermark: str = "2 minutes", trigger: dict | None = None) -> StreamingQuery:
    """Minutes that changed, published batch by batch, for consumers to follow."""
    changed = facts.minute_facts(events, watermark)
    return changed.writeStream.foreachBatch(lambda batch, batch_id: publish_facts(batch.sparkSession, base, batch_id, batch)).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def follow(spark: SparkSession, facts_base: str, base: str, min_events: int = 5) -> int:
    """Take in the facts published since this consumer's mark; how many versions.

    The mark is the version of the facts that the newest record of the chain
    names; the record appears with the tables or not at all, so a crash before
    it leaves the old mark with the old tables, and the step is made again.
    """
    source, mine = (commits.Batch(spark, b, c, -1) for b, c in ((facts_base, "facts"), (base, "chain")))
    newest, seen = source.version - 1, max(mine.taken, 0)
    if newest <= seen:
        return 0
    new = source.read("facts", source.parts_since("facts", seen)).filter(F.col("version") > seen)
    step(commits.Batch(spark, base, "chain", newest), lambda days: commits.settled(source.read("facts", [str(d) for d in days]), MINUTE), new, min_events)
    return newest - seen
