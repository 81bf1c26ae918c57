"""Risk per asset and minute, by two policies with separate outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plantpulse.config import LIMITS, RiskOptions
from plantpulse.functions.columns import dashboard_band, half_even_score, minute_number
from plantpulse.operators.chunks import in_chunks, own
from plantpulse.operators.detect import limit_severity
from plantpulse.sources.sinks import newest


def threshold_risk(enriched: DataFrame) -> DataFrame:
    """Sum of 10 (warning) and 20 (critical) times criticality, every minute.

    Needs the facts' averages and ``criticality_weight``; quiet minutes score 0.
    """
    severities = [(limit, limit_severity(limit)) for limit in LIMITS]
    base = sum((F.when(s == 2, 20).when(s == 1, 10).otherwise(0) for _, s in severities), F.lit(0))
    weight = F.coalesce("criticality_weight", F.lit(1.0))
    score = F.least(F.bround(base * weight, 0).cast("double"), F.lit(100.0))
    types = [F.when(s.isNotNull(), limit.anomaly_type) for limit, s in severities]
    count = sum((s.isNotNull().cast("int") for _, s in severities), F.lit(0))
    return enriched.select(
        "asset_id", "minute_ts", score.alias("risk_score"), dashboard_band(score).alias("risk_level"), F.coalesce(*types).alias("failure_mode"), F.nullif(F.concat_ws(",", *types), F.lit("")).alias("top_drivers"),
        F.to_json(F.struct(count.alias("anomaly_count"), weight.alias("criticality_weight"))).alias("evidence_json"),
    )


def points(options: RiskOptions) -> Column:
    severe = F.col("severity") >= 3
    out = F.lit(options.other)
    for kind, (two, three) in options.points.items():
        out = F.when(F.col("anomaly_type") == kind, F.when(severe, three).otherwise(two)).otherwise(out)
    return out


#: Types in the order of ties.
TYPES = ("CURRENT_DRIFT", "CURRENT_HIGH", "FLOW_DROP", "TEMP_DRIFT", "TEMP_HIGH", "VIB_DRIFT", "VIB_SPIKE")


def failure_mode(has) -> Column:
    """``has(type)`` tells whether the window holds a type."""
    current = has("CURRENT_DRIFT") | has("CURRENT_HIGH")
    return (
        F.when(has("TEMP_DRIFT") & has("VIB_DRIFT"), "BEARING_WEAR")
        .when(has("FLOW_DROP") & (has("VIB_SPIKE") | has("VIB_DRIFT")), "CAVITATION")
        .when(has("FLOW_DROP") & current, "OVERLOAD")
    )


def minute_points(anomalies: DataFrame, options: RiskOptions) -> DataFrame:
    """Anomalies summed to one row an asset and minute, all a window needs:
    points, and for each type (an unknown type by its name) its count."""
    rows = anomalies.withColumns({"__m": minute_number(F.col("minute_ts")), "__p": points(options)})
    per_type = rows.groupBy("asset_id", "minute_ts", "__m", "anomaly_type").agg(F.sum("__p").alias("p"), F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("severity", F.col("__p").alias("points")))).alias("each"))
    return per_type.groupBy("asset_id", "minute_ts", "__m").agg(F.sum("p").cast("bigint").alias("__points"), F.sort_array(F.collect_list(F.struct("anomaly_type", "n", "each"))).alias("__types"))


def decay_risk(anomalies: DataFrame, options: RiskOptions = RiskOptions(), minutes: DataFrame | None = None) -> DataFrame:
    """Points of the last ``window_minutes`` minutes, fading linearly with age.

    With points and ages in whole numbers the sum over the window is
    ((W - t) * sum(p) + sum(p * t_i)) / W, exact in integers until the last
    division.  Only minutes with anomalies score, unless ``minutes``
    (asset_id, minute_ts) names more to score.
    """
    width = options.window_minutes
    rows = minute_points(anomalies, options)
    if minutes is not None:
        wanted = minutes.select("asset_id", "minute_ts").distinct()
        rows = wanted.join(rows.drop("__m"), ["asset_id", "minute_ts"], "full").withColumns({"__m": minute_number(F.col("minute_ts")), "__points": F.coalesce("__points", F.lit(0).cast("bigint")), "__types": F.coalesce("__types", F.array().cast(rows.schema["__types"].dataType))})
    rows = in_chunks(rows.withColumn("__s", F.col("__m") * 60), "__s", 60 * (width - 1))
    w = W.partitionBy("asset_id", "__chunk").orderBy("__m").rangeBetween(-(width - 1), 0)
    total, weighted = F.sum("__points").over(w), F.sum(F.col("__points") * F.col("__m")).over(w)
    held = F.flatten(F.collect_list(F.transform("__types", lambda t: F.struct(F.col("__m").alias("m"), t["anomaly_type"].alias("t"), t["n"].alias("n"), t["each"].alias("each")))).over(w))
    d = own(rows.withColumns({"__exact": ((width - F.col("__m")) * total + weighted) / width, "__held": held}))
    score = half_even_score(F.col("__exact")).cast("int")
    d = d.withColumns({"risk_score": score, "__names": F.array_distinct(F.transform("__held", lambda x: x["t"]))})
    level = F.when(F.col("risk_score") <= options.low_max, "LOW").when(F.col("risk_score") <= options.med_max, "MED").otherwise("HIGH")
    # drivers by count, then by when they were first seen, then by name
    counted = F.transform(
        "__names",
        lambda name: F.struct(
            (-F.aggregate(F.filter("__held", lambda x: x["t"] == name), F.lit(0), lambda a, x: a + x["n"])).alias("less"),
            F.array_min(F.transform(F.filter("__held", lambda x: x["t"] == name), lambda x: x["m"])).alias("first"),
            name.alias("name"),
        ),
    )
    d = d.withColumn("__drivers", F.array_sort(counted))
    top = F.concat_ws(", ", F.transform(F.slice("__drivers", 1, 3), lambda x: F.concat(x["name"], F.lit("x"), (-x["less"]).cast("string"))))
    each = F.flatten(F.transform("__held", lambda x: F.transform(x["each"], lambda e: F.struct(x["t"].alias("anomalyType"), e["severity"].alias("severity"), x["m"].alias("minute"), e["points"].alias("basePoints"), (1 - (F.col("__m") - x["m"]) / width).alias("decay")))))
    counts = F.map_from_entries(F.transform("__drivers", lambda x: F.struct(x["name"], -x["less"])))
    evidence = F.to_json(F.struct(F.lit(width).alias("windowMinutes"), counts.alias("driverCounts"), F.slice(each, 1, options.evidence_rows).alias("contributions")))
    return d.select(
        "asset_id", "minute_ts", "risk_score", level.alias("risk_level"), failure_mode(lambda t: F.array_contains("__names", t)).alias("failure_mode"), top.alias("top_drivers"), evidence.alias("evidence_json")
    )


#: What ``decay_risk`` writes as evidence.
EVIDENCE = "windowMinutes int, driverCounts map<string,int>, contributions array<struct<anomalyType:string,severity:int,minute:bigint,basePoints:int,decay:double>>"


def read_evidence(risk: DataFrame) -> DataFrame:
    """Risk rows with ``evidence``, the typed reading of ``evidence_json``; null where it is none."""
    return risk.withColumn("evidence", F.when(F.try_parse_json("evidence_json").isNotNull(), F.from_json("evidence_json", EVIDENCE)))


def current_risk(risk: DataFrame) -> DataFrame:
    """The newest row of each asset, as a table of current states."""
    return newest(risk.withColumnRenamed("minute_ts", "as_of_minute_ts"), ["asset_id"], "as_of_minute_ts")


