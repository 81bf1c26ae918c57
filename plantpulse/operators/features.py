"""Features of the hybrid detector, per asset and minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.operators.chunks import in_chunks, own

#: Minutes are counted from here in slopes, so that sums of squares stay small.
ORIGIN_MINUTE = 28_401_120
MEANS = {"temp_avg_15m": "avg_temp_c", "vib_avg_15m": "avg_vib_mm_s", "current_avg_15m": "avg_current_a", "flow_avg_15m": "avg_flow_m3h", "pressure_avg_15m": "avg_pressure_bar"}
SLOPES = {"temp_slope_15m": "avg_temp_c", "vib_slope_15m": "avg_vib_mm_s", "current_slope_15m": "avg_current_a"}
COLUMNS = ["asset_id", "minute_ts", *MEANS, "vib_std_60m", *SLOPES, "flow_drop_pct_15m", "run_minutes_60m", "quality_gate_ok"]


def features_minimal(facts: DataFrame, min_events: int = 5) -> DataFrame:
    """One-minute averages in the place of rolling ones; no slopes or drops."""
    none = F.lit(None).cast("double")
    return facts.select(
        "asset_id", "minute_ts", *[F.col(c).alias(n) for n, c in MEANS.items()], none.alias("vib_std_60m"), *[none.alias(n) for n in SLOPES], none.alias("flow_drop_pct_15m"),
        F.col("event_count").alias("run_minutes_60m"), (F.col("event_count") >= min_events).alias("quality_gate_ok"),
    )


def features_rolling(facts: DataFrame, min_events: int = 5) -> DataFrame:
    """Rolling means, spread, slopes, flow drop and run minutes.

    The formulas are this library's own: means and least-squares slopes over
    the last 15 minutes, sample deviation and minutes with data over 60, and
    flow against its mean of the 15 minutes before (null unless positive).
    """
    rows = in_chunks(facts.withColumn("__s", F.unix_seconds("minute_ts")), "__s", 3540)
    w = W.partitionBy("asset_id", "__chunk").orderBy("__s")
    quarter, hour, before = w.rangeBetween(-840, 0), w.rangeBetween(-3540, 0), w.rangeBetween(-900, -60)
    x = (F.col("__s") / 60).cast("bigint") - ORIGIN_MINUTE
    base = F.avg("avg_flow_m3h").over(before)
    out = {n: F.avg(c).over(quarter) for n, c in MEANS.items()}
    out["vib_std_60m"] = F.stddev_samp("avg_vib_mm_s").over(hour)
    out |= {n: F.regr_slope(F.col(c), x).over(quarter) for n, c in SLOPES.items()}
    out["flow_drop_pct_15m"] = F.when(base > 0, F.col("avg_flow_m3h") / base - 1)
    out["run_minutes_60m"] = F.count("*").over(hour).cast("int")
    out["quality_gate_ok"] = F.col("event_count") >= min_events
    return own(rows.withColumns(out)).select(*COLUMNS)
