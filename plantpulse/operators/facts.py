"""One-minute facts per asset; the same code for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.config import SIGNALS

PROFILE_DEFAULTS = {
    "location": "Unknown", "asset_category": "Unknown", "manufacturer": "Unknown", "install_year": 0,
    "rated_capacity_pct": 100.0, "maintenance_interval_days": 90, "criticality": "MEDIUM", "criticality_weight": 1.0,
}


def spread_tags(telemetry: DataFrame) -> DataFrame:
    """Tag rows as nullable signal columns, with the fault code as an integer."""
    tag, value = F.col("tag"), F.col("value")
    columns = {name: F.when(tag == t, value) for t, name in SIGNALS.items()}
    return telemetry.withColumns(columns | {"fault_code": F.when(tag == "fault_code", value.try_cast("int"))})


def minute_facts(telemetry: DataFrame, watermark: str | None = None) -> DataFrame:
    """Averages of the five signals, event count and highest fault code.

    The count is of all good rows of the minute, whatever their tag.  With a
    watermark the result can be written from a stream.
    """
    source = telemetry.withWatermark("ts", watermark) if watermark else telemetry
    wide = spread_tags(source)
    aggs = [F.avg(c).alias(c) for c in SIGNALS.values()]
    grouped = wide.groupBy("asset_id", F.window("ts", "1 minute").alias("w")).agg(*aggs, F.count("*").cast("int").alias("event_count"), F.max("fault_code").alias("fault_code_max"))
    return grouped.select("asset_id", F.col("w.start").alias("minute_ts"), *SIGNALS.values(), "event_count", "fault_code_max")


def enrich(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts with their asset's profile; defaults where there is none.

    Profiles are a dimension: one row an asset.  Spark broadcasts it below its
    size limit and shuffles it beyond.
    """
    joined = facts.join(profiles, "asset_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in PROFILE_DEFAULTS.items()}).select(*facts.columns, *PROFILE_DEFAULTS)


def fault_bitmask(facts: DataFrame) -> DataFrame:
    """Facts with the bits of the limits that their averages break."""
    bits = ((F.col("avg_temp_c") > 80, 1), (F.col("avg_vib_mm_s") > 5, 2), (F.col("avg_current_a") > 28, 4), (F.col("avg_flow_m3h") < 80, 8), (F.col("avg_pressure_bar") < 6, 16))
    return facts.withColumn("fault_bits", sum((F.when(c, b).otherwise(0) for c, b in bits), F.lit(0)))
