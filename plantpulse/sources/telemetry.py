"""Where telemetry and asset profiles come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse import schemas
from plantpulse.config import GOOD_QUALITY

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ASSETS = ("COMP_001", "FAN_001", "GBX_001", "PUMP_001", "PUMP_002", "EXTRA_001")
#: The plant's five profiled assets (fixed values).
PROFILE_ROWS = (
    ("COMP_001", "Building-A", "Compressor", "Atlas Copco", 2019, 150, 90, "HIGH", 1.25),
    ("FAN_001", "Building-B", "Fan", "Ebm-papst", 2020, 5000, 180, "MEDIUM", 1.00),
    ("GBX_001", "Production-Floor", "Gearbox", "SEW-EURODRIVE", 2018, 75, 60, "HIGH", 1.25),
    ("PUMP_001", "Utility-Room", "Pump", "Grundfos", 2021, 120, 90, "MEDIUM", 1.00),
    ("PUMP_002", "Utility-Room", "Pump", "Grundfos", 2022, 120, 180, "LOW", 0.80),
)


def read_kafka(spark: SparkSession, servers: str, topic: str, group: str | None = None, starting: str = "latest") -> DataFrame:
    """A streaming DataFrame of raw messages; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "false")
    return (reader.option("kafka.group.id", group) if group else reader).load()


def read_message_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines as a stream in the shape of raw messages."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("value", F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("int").alias("partition"))


def _decoded(raw: DataFrame) -> DataFrame:
    event = F.from_json(F.col("value").cast("string"), schemas.TELEMETRY)
    return raw.select(event.alias("e"), F.col("offset").alias("kafka_offset"), F.col("partition").alias("kafka_partition"), F.col("value").cast("string").alias("message")).select(
        "e.*", F.try_to_timestamp(F.col("e.ts"), F.lit(TS_FORMAT)).alias("event_ts"), "kafka_offset", "kafka_partition", "message"
    )


def parse_events(raw: DataFrame) -> DataFrame:
    """Typed good-quality events; malformed, untimed and unnamed ones drop out."""
    d = _decoded(raw).filter(F.col("event_ts").isNotNull() & F.col("asset_id").isNotNull() & (F.col("quality") == GOOD_QUALITY))
    return d.select("asset_id", "asset_type", F.col("event_ts").alias("ts"), "tag", "value", "quality", "kafka_offset", "kafka_partition")


def rejected_events(raw: DataFrame) -> DataFrame:
    """The messages that ``parse_events`` drops, each with the first reason."""
    d = _decoded(raw)
    unread = F.col("asset_id").isNull() & F.col("ts").isNull() & F.col("tag").isNull() & F.col("value").isNull() & F.col("quality").isNull()
    reason = (
        F.when(unread, "malformed").when(F.col("event_ts").isNull(), "bad timestamp").when(F.col("asset_id").isNull(), "no asset").when(~F.coalesce(F.col("quality") == GOOD_QUALITY, F.lit(False)), "quality")
    )
    return d.withColumn("reason", reason).filter("reason is not null").select("message", "reason", "kafka_offset", "kafka_partition")


def good_events(telemetry: DataFrame) -> DataFrame:
    return telemetry.filter(F.col("ts").isNotNull() & F.col("asset_id").isNotNull() & (F.col("quality") == GOOD_QUALITY))


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Tall telemetry derived from the generic events table.

    Thirty days are pressed 60:1 into twelve hours; users become six assets
    and event types become tags with values in the sensors' ranges.
    """
    kind, v = F.col("event_type"), F.col("value")
    tag = F.when(kind == "click", "temp_bearing_c").when(kind == "view", "vib_rms_mm_s").when(kind == "purchase", "motor_current_a").when(kind == "signup", "flow_rate_m3_h").otherwise("discharge_pressure_bar")
    value = F.when(kind == "click", 40 + v * 0.5).when(kind == "view", 1 + v * 0.06).when(kind == "purchase", 14 + v * 0.15).when(kind == "signup", 125 - v * 0.6).otherwise(9 - v * 0.04)
    asset = F.element_at(F.array(*map(F.lit, ASSETS)), (F.col("user_id") % 6).cast("int") + 1)
    prefix = F.split(asset, "_")[0]
    asset_type = F.when(prefix == "COMP", "Compressor").when(prefix == "FAN", "Fan").when(prefix == "GBX", "Gearbox").when(prefix == "PUMP", "Pump")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))")
    ts = F.expr("timestamp_micros(1704067200000000 + micros div 60)")
    quality = F.when(F.get_json_object("props", "$.k").cast("int") % 10 == 0, 64).otherwise(192)
    return events.withColumn("micros", micros).select(
        asset.alias("asset_id"), asset_type.alias("asset_type"), ts.alias("ts"), tag.alias("tag"), value.alias("value"), quality.alias("quality"),
        F.col("event_id").cast("bigint").alias("kafka_offset"), (F.col("user_id") % 6).cast("int").alias("kafka_partition"),
    )


def load_asset_profiles(spark: SparkSession, path: str | None = None, view: str | None = None) -> DataFrame:
    """The profile dimension, from a CSV with a header or the built-in rows."""
    df = spark.read.schema(schemas.PROFILES).csv(path, header=True) if path else spark.createDataFrame(list(PROFILE_ROWS), schemas.PROFILES)
    if view:
        df.createOrReplaceTempView(view)
    return df


def incremental(df: DataFrame, ts: str, last, until=None) -> DataFrame:
    """Rows after a high-water mark, in time order."""
    out = df.filter(F.col(ts) > F.lit(last))
    return (out.filter(F.col(ts) <= F.lit(until)) if until is not None else out).orderBy(ts)


def high_water_mark(df: DataFrame, ts: str) -> DataFrame:
    """One row with the newest time, to be stored beside the consumer's output."""
    return df.agg(F.max(ts).alias("last"))


def read_tables(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables of one folder by name."""
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}
