"""Anomaly rules as column expressions: one pass, no union of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.config import DEPLOYED_HYBRID, LIMITS, HybridThresholds, Limit
from plantpulse.operators.chunks import in_chunks, own


def limit_severity(limit: Limit) -> Column:
    """2 past the critical limit, 1 past the warning limit, else null."""
    c = F.col(limit.column)
    if limit.below:
        return F.when(c < limit.crit, 2).when(c < limit.warn, 1)
    return F.when(c > limit.crit, 2).when(c > limit.warn, 1)


def _emit(df: DataFrame, found: list[Column]) -> DataFrame:
    """A row for each anomaly struct that isn't null."""
    return df.select("asset_id", "minute_ts", F.inline(F.filter(F.array(*found), lambda a: a.isNotNull())))


def threshold_anomalies(facts: DataFrame) -> DataFrame:
    """Minute averages past fixed limits; a null average breaks none."""
    found = []
    for limit in LIMITS:
        severity = limit_severity(limit)
        word = "below" if limit.below else "exceeds"
        text = F.when(severity == 2, f" {word} critical {limit.crit}").otherwise(f" {word} warning {limit.warn}")
        reason = F.concat(F.lit(f"{limit.tag}="), F.format_string("%.3f", limit.column), text)
        found.append(F.when(severity.isNotNull(), F.struct(F.lit(limit.anomaly_type).alias("anomaly_type"), F.lit(limit.tag).alias("signal"), F.col(limit.column).alias("score"), severity.alias("severity"), reason.alias("reason"), F.lit(None).cast("string").alias("evidence_json"))))
    return _emit(facts, found)


#: Signal, its mean and slope column, and the spike and drift types.
_HYBRID = (("vibration", "vib", "VIB_SPIKE", "VIB_DRIFT"), ("temperature", "temp", "TEMP_HIGH", "TEMP_DRIFT"), ("current", "current", "CURRENT_HIGH", "CURRENT_DRIFT"))


def hybrid_windows(features: DataFrame, t: HybridThresholds = DEPLOYED_HYBRID) -> DataFrame:
    """Gated features with each rule's baseline and run of slopes.

    Ungated minutes are neither scored nor part of any lookback; the gate on
    run minutes is for the current minute alone, so it comes after windowing.
    """
    k = max(2, t.drift_minutes)
    gated = features.filter("quality_gate_ok").withColumn("__s", F.unix_seconds("minute_ts"))
    rows = in_chunks(gated, "__s", 60 * max(t.lookback_minutes, k))
    w = W.partitionBy("asset_id", "__chunk").orderBy("__s")
    back = w.rangeBetween(-60 * t.lookback_minutes, -1)
    out = {"__lookback": F.count("*").over(back), "__k_back": F.lag("__s", k - 1).over(w)}
    for _, p, _, _ in _HYBRID:
        value, slope = f"{p}_avg_15m", f"{p}_slope_15m"
        out[f"__{p}_n"] = F.count(value).over(back)
        out[f"__{p}_mean"] = F.avg(value).over(back)
        out[f"__{p}_std"] = F.stddev_samp(value).over(back)
        out[f"__{p}_slopes"] = F.array(*[F.lag(slope, i).over(w) for i in range(k - 1, 0, -1)], F.col(slope))
    ready = own(rows.withColumns(out)).filter((F.coalesce("run_minutes_60m", F.lit(0)) >= t.min_run_minutes) & (F.col("__lookback") >= t.min_rows_for_baseline))
    # k rows that end at k - 1 minutes distance are a minute apart each
    return ready.withColumn("__run", F.coalesce(F.col("__k_back") == F.col("__s") - 60 * (k - 1), F.lit(False)))


def hybrid_anomalies(features: DataFrame, t: HybridThresholds = DEPLOYED_HYBRID) -> DataFrame:
    """Z-score spikes, slope drifts and flow drops."""
    k = max(2, t.drift_minutes)
    found = []

    def anomaly(fires, kind, signal, score, severity, reason, evidence):
        return F.when(fires, F.struct(F.lit(kind).alias("anomaly_type"), F.lit(signal).alias("signal"), score.alias("score"), severity.alias("severity"), reason.alias("reason"), F.to_json(evidence).alias("evidence_json")))

    number = lambda c: F.call_function("format_number", c, F.lit("0.###"))
    for signal, p, spike, _ in _HYBRID:
        value, mean = F.col(f"{p}_avg_15m"), F.col(f"__{p}_mean")
        std = F.greatest(F.coalesce(F.col(f"__{p}_std"), F.lit(0.0)), F.lit(getattr(t, f"{p}_std_eps")))
        z = (value - mean) / std
        fires = (F.col(f"__{p}_n") >= t.min_rows_for_baseline) & (z >= t.z_warn)
        reason = F.concat(F.lit(f"{signal} spike: z="), F.call_function("format_number", z, F.lit("0.00")), F.lit(" (val="), number(value), F.lit(", mean="), number(mean), F.lit(", std="), number(std), F.lit(")"))
        found.append(anomaly(fires, spike, signal, z, F.when(z >= t.z_severe, 3).otherwise(2), reason, F.struct(value.alias("val"), mean.alias("mean"), std.alias("std"), z.alias("z"))))
    for signal, p, _, drift in _HYBRID:
        slopes, low, severe = F.col(f"__{p}_slopes"), getattr(t, f"{p}_drift_slope"), getattr(t, f"{p}_severe_slope")
        whole = ~F.exists(slopes, lambda s: s.isNull())
        average = F.aggregate(slopes, F.lit(0.0), lambda a, s: a + F.coalesce(s, F.lit(0.0))) / k
        fires = F.col("__run") & whole & F.forall(slopes, lambda s: s >= low)
        reason = F.concat(F.lit(f"{signal} drift: slope >= {low:g} for {k} consecutive minutes (avgSlope="), number(average), F.lit(")."))
        found.append(anomaly(fires, drift, signal, average, F.when(F.forall(slopes, lambda s: s >= severe), 3).otherwise(2), reason, F.struct(F.lit(k).alias("k"), F.lit(low).alias("driftSlope"), F.lit(severe).alias("severeSlope"), slopes.alias("slopes"))))
    drop = F.col("flow_drop_pct_15m")
    reason = F.concat(F.lit("Flow dropped "), F.call_function("format_number", drop * 100, F.lit("0.#")), F.lit("% vs baseline."))
    found.append(anomaly(drop <= t.flow_drop, "FLOW_DROP", "flow", drop, F.when(drop <= t.flow_drop_severe, 3).otherwise(2), reason, F.struct(drop.alias("flowDropPct"))))
    return _emit(hybrid_windows(features, t), found)
