"""The queries a dashboard, report or service asks.

Every top-k has a full order, so a result doesn't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.functions.columns import between, check_range, check_step, clamp, normal_status
from plantpulse.sources.sinks import latest_per_key


def list_assets(current: DataFrame, q: str | None = None, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """A page of assets by id; ``q`` is matched literally."""
    df = current.select("asset_id", "as_of_minute_ts", "risk_score", "risk_level")
    if q:
        df = df.filter(F.contains("asset_id", F.lit(q)))
    if cursor:
        df = df.filter(F.col("asset_id") > cursor)
    return df.orderBy("asset_id").limit(clamp(limit, 100, 500))


def next_cursor(page: list, limit: int) -> str | None:
    """The cursor after a page; none if the page isn't full."""
    return page[-1]["asset_id"] if len(page) == limit else None


def asset_summary(current: DataFrame, recs: DataFrame, asset_id: str | None = None) -> DataFrame:
    """Current risk with counts of open and acknowledged recommendations."""
    counts = recs.groupBy("asset_id").agg(F.count_if(F.col("status") == "OPEN").alias("open_recommendations"), F.count_if(F.col("status") == "ACKED").alias("acked_recommendations"))
    base = current if asset_id is None else current.filter(F.col("asset_id") == asset_id)
    return base.join(counts, "asset_id", "left").fillna(0, ["open_recommendations", "acked_recommendations"])


def risk_buckets(risk: DataFrame, step: int) -> DataFrame:
    """The greatest risk of every asset's buckets of ``step`` minutes."""
    return (
        risk.groupBy("asset_id", F.window("minute_ts", f"{step} minutes").alias("w"))
        .agg(F.max("risk_score").alias("risk_score"), F.max("risk_level").alias("risk_level"), F.max("failure_mode").alias("failure_mode"), F.max_by("risk_level", "risk_score").alias("level_at_max"))
        .select("asset_id", F.col("w.start").alias("minute_ts"), "risk_score", "risk_level", "failure_mode", "level_at_max")
    )


def risk_series(risk: DataFrame, asset_id: str | None, start, end, step: int = 1) -> DataFrame:
    """Risk over time; steps of 5 and 15 minutes keep each bucket's greatest.

    ``risk_level`` of a bucket is the greatest by alphabet, for parity;
    ``level_at_max`` is that of the greatest score.
    """
    check_range(start, end)
    df = risk.filter(between("minute_ts", start, end))
    if asset_id is not None:
        df = df.filter(F.col("asset_id") == asset_id)
    if check_step(step) == 1:
        out = df.select("asset_id", "minute_ts", "risk_score", "risk_level", "failure_mode", F.col("risk_level").alias("level_at_max"))
    else:
        out = risk_buckets(df, step)
    return out.orderBy("asset_id", "minute_ts")


def rollup_series(rollups: DataFrame, asset_id: str | None, start, end, step: int | None = None) -> DataFrame:
    """Risk by 5 or 15 minutes from the kept rollups; no minute row is read.

    Whole buckets: those that start in the range.  None means both steps.
    """
    check_range(start, end)
    df = rollups.filter(between("minute_ts", start, end))
    if step is not None:
        df = df.filter(F.col("step") == check_step(step))
    if asset_id is not None:
        df = df.filter(F.col("asset_id") == asset_id)
    return df.orderBy("asset_id", "step", "minute_ts")


def anomalies_in_range(anomalies: DataFrame, asset_id: str | None, start, end, take: int | None = None) -> DataFrame:
    """The earliest anomalies of a time range."""
    check_range(start, end)
    df = anomalies.filter(between("minute_ts", start, end))
    if asset_id is not None:
        df = df.filter(F.col("asset_id") == asset_id)
    return df.orderBy("minute_ts", "asset_id", "anomaly_type").limit(clamp(take, 500, 2000))


def newest_first(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(F.desc("minute_ts"), "asset_id", "anomaly_type")


def _with_status(recs: DataFrame, status: str | None, default) -> DataFrame:
    kept = normal_status(status, default)
    return recs if kept is None else recs.filter(F.col("status").isin(*kept))


def rec_queue(recs: DataFrame, status: str | None = "OPEN", take: int | None = None, asset_id: str | None = None) -> DataFrame:
    df = _with_status(recs, status, ("OPEN",))
    if asset_id is not None:
        df = df.filter(F.col("asset_id") == asset_id)
    return df.orderBy(F.desc("as_of_minute_ts"), F.desc("created_at"), "asset_id", "rec_type", "recommendation_id").limit(clamp(take, 50, 500))


def asset_recs(recs: DataFrame, asset_id: str | None = None, status: str | None = None, take: int | None = None) -> DataFrame:
    df = _with_status(_of(recs, None if asset_id is None else [asset_id]), status, None)
    return df.orderBy(F.desc("created_at"), F.desc("as_of_minute_ts"), "asset_id", "rec_type", "recommendation_id").limit(clamp(take, 100, 500))


def risk_span(risk: DataFrame, start, end) -> DataFrame:
    """Per asset: latest, lowest, highest and mean score, and the trend."""
    df = risk.filter(between("minute_ts", start, end)).groupBy("asset_id")
    last, first = F.max_by("risk_score", "minute_ts"), F.min_by("risk_score", "minute_ts")
    delta = last - first
    trend = F.when(delta > 10, "rising").when(delta < -10, "falling").otherwise("flat")
    return df.agg(last.alias("latest_score"), F.max_by("risk_level", "minute_ts").alias("latest_level"), trend.alias("trend"), F.min("risk_score").alias("min_score"), F.max("risk_score").alias("max_score"), F.avg("risk_score").alias("avg_score"))


def insight_facts(current: DataFrame, recs: DataFrame, risk: DataFrame, anomalies: DataFrame, start, end, n_anomalies: int = 20, n_recs: int = 10) -> DataFrame:
    """What a summary of each asset needs, for all assets in one job."""
    span = risk_span(risk, start, end)
    recent = anomalies.filter(between("minute_ts", start, end))
    rank = F.row_number().over(W.partitionBy("asset_id").orderBy(F.desc("minute_ts"), "anomaly_type"))
    top = recent.withColumn("rn", rank).filter(F.col("rn") <= n_anomalies).groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "minute_ts", "anomaly_type", "signal", "score", "severity"))), lambda x: x.dropFields("rn")).alias("anomalies"))
    rank = F.row_number().over(W.partitionBy("asset_id").orderBy(F.desc("created_at"), "recommendation_id"))
    opened = recs.filter("status = 'OPEN'").withColumn("rn", rank).filter(F.col("rn") <= n_recs)
    opened = opened.groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "recommendation_id", "rec_type", "priority", "title", "confidence"))), lambda x: x.dropFields("rn")).alias("recommendations"))
    out = asset_summary(current, recs).join(span, "asset_id", "left").join(top, "asset_id", "left").join(opened, "asset_id", "left")
    return out.withColumn("trend", F.coalesce("trend", F.lit("unknown")))


def risk_markers(risk: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Risk points with a flag for minutes that have an anomaly."""
    marked = anomalies.select("asset_id", "minute_ts").distinct().withColumn("has_anomaly", F.lit(True))
    return risk.join(marked, ["asset_id", "minute_ts"], "left").fillna(False, ["has_anomaly"])


# ---- dashboard panels ------------------------------------------------------


def _of(df: DataFrame, assets: list[str] | None) -> DataFrame:
    """Rows of these assets; None means all."""
    return df if assets is None else df.filter(F.col("asset_id").isin(assets))


def panel_score_by_asset(current: DataFrame, assets: list[str] | None = None) -> DataFrame:
    return _of(current, assets).select(F.col("asset_id").alias("metric"), F.col("risk_score").alias("value")).orderBy("metric")


def panel_levels(current: DataFrame, assets: list[str] | None = None) -> DataFrame:
    return _of(current, assets).select("asset_id", "risk_score", "risk_level", "failure_mode", "top_drivers", "as_of_minute_ts").orderBy(F.desc("risk_score"), "asset_id")


def panel_series(df: DataFrame, column: str, assets: list[str] | None, start, end, ts: str = "minute_ts") -> DataFrame:
    """time, metric, value of one column: temperature, vibration, risk, ..."""
    kept = _of(df, assets).filter(between(ts, start, end))
    return kept.select(F.col(ts).alias("time"), F.col("asset_id").alias("metric"), F.col(column).alias("value")).orderBy("time", "metric")


def panel_anomalies(anomalies: DataFrame, assets: list[str] | None, start, end, take: int = 100) -> DataFrame:
    kept = _of(anomalies, assets).filter(between("minute_ts", start, end))
    return newest_first(kept).limit(take)


def panel_assets(current: DataFrame) -> DataFrame:
    return current.select("asset_id").distinct().orderBy("asset_id")


# ---- reports and checks ----------------------------------------------------


def report_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_latest(df: DataFrame, columns: dict[str, int | None], order: list, take: int) -> DataFrame:
    """The newest rows, with columns rounded to the given places."""
    shown = [F.col(c) if places is None else F.round(c, places).alias(c) for c, places in columns.items()]
    return df.orderBy(*order).limit(take).select(*shown)


def report_raw(telemetry: DataFrame, take: int = 5) -> DataFrame:
    return report_latest(telemetry, {"asset_id": None, "asset_type": None, "ts": None, "tag": None, "value": 2, "quality": None}, [F.desc("ts"), F.desc("kafka_offset")], take)


def report_facts(facts: DataFrame, take: int = 10) -> DataFrame:
    columns = {"asset_id": None, "minute_ts": None, "avg_temp_c": 1, "avg_vib_mm_s": 3, "avg_current_a": 2, "avg_flow_m3h": 2, "event_count": None}
    return report_latest(facts, columns, [F.desc("minute_ts"), "asset_id"], take)


def report_anomalies(anomalies: DataFrame, take: int = 10) -> DataFrame:
    columns = {"asset_id": None, "minute_ts": None, "anomaly_type": None, "signal": None, "severity": None, "score": 2}
    return report_latest(anomalies, columns, [F.desc("minute_ts"), "asset_id", "anomaly_type"], take)


def report_risk(risk: DataFrame, take: int = 10) -> DataFrame:
    columns = {"asset_id": None, "minute_ts": None, "risk_score": 1, "risk_level": None, "failure_mode": None, "top_drivers": None}
    return report_latest(risk, columns, [F.desc("minute_ts"), "asset_id"], take)


def report_enriched(enriched: DataFrame, take: int = 10) -> DataFrame:
    columns = {"asset_id": None, "minute_ts": None, "avg_temp_c": 1, "avg_vib_mm_s": 3, "location": None, "asset_category": None, "manufacturer": None, "criticality": None, "criticality_weight": None, "maintenance_interval_days": None}
    return report_latest(enriched, columns, [F.desc("minute_ts"), "asset_id"], take)


def ops_fact_risk(facts: DataFrame, current: DataFrame) -> DataFrame:
    """Minute facts beside their asset's current risk."""
    return facts.join(current.select("asset_id", "risk_score", "risk_level"), "asset_id")


def ops_rows_per_asset(df: DataFrame) -> DataFrame:
    return df.groupBy("asset_id").agg(F.count("*").alias("n_rows"))


def latest_active(recs: DataFrame) -> DataFrame:
    """The newest recommendation that isn't closed of each asset and type."""
    return latest_per_key(recs.filter("status <> 'CLOSED'"), ["asset_id", "rec_type"], F.desc("created_at"), F.desc("recommendation_id"))
