"""Registered queries of the plant operators and their DuckDB SQL.

All start from the events table, read as telemetry (see ``sources``).  Times
are shown as text and doubles rounded to 6 places, so that engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse import schemas
from plantpulse.config import DEPLOYED_HYBRID as H
from plantpulse.config import FAMILIES, GENERAL_FAMILY, LIMITS, RULES, SIGNALS, RiskOptions
from plantpulse.functions.columns import dashboard_band, normalise_replies, severity_badge, ui_badge
from plantpulse.operators import detect, facts, features, recommend, risk
from plantpulse.plans import pages, serving
from plantpulse.session import scratch_folder, ship_package, sized_caches
from plantpulse.sources import sinks, telemetry
from plantpulse.streaming import analytics, chain, jobs, late, windows

#: Events in a minute from which it counts; the test tables are thin.
MIN_EVENTS = 1
#: A range of time that holds every row; the queries serve all assets.
START, END = "2000-01-01 00:00:00", "2100-01-01 00:00:00"

#: Lifts exact ties of the 7th place over the edge, where engines' last bits differ.
NUDGE = 1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Plant:
    """The tables of the plant, each a lazy DataFrame over the events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self.telemetry = telemetry.telemetry_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
        self.good = telemetry.good_events(self.telemetry)
        self.facts = facts.minute_facts(self.good)
        self.profiles = telemetry.load_asset_profiles(spark)

    @property
    def enriched(self):
        return facts.enrich(self.facts, self.profiles)

    @property
    def limits(self):
        return detect.threshold_anomalies(self.facts)

    @property
    def limit_risk(self):
        return risk.threshold_risk(self.enriched)

    @property
    def rolling(self):
        return features.features_rolling(self.facts, MIN_EVENTS)

    @property
    def hybrid(self):
        return detect.hybrid_anomalies(self.rolling)

    @property
    def decay(self):
        return risk.decay_risk(self.hybrid)

    @property
    def recs(self):
        """A recommendation for each risk minute that calls for one; the
        minute's number decides its status."""
        return self.made(self.decay)

    def made(self, scored: DataFrame) -> DataFrame:
        made = recommend.recommend(scored.withColumnRenamed("minute_ts", "as_of_minute_ts"))
        n = F.unix_seconds("as_of_minute_ts") / 60 % 3
        none = F.lit(None)
        extra = {
            "recommendation_id": recommend.recommendation_id(), "status": F.when(n == 0, "OPEN").when(n == 1, "ACKED").otherwise("CLOSED"), "ack_until": none.cast("timestamp"), "closed_at": none.cast("timestamp"),
            "closed_by": none.cast("string"), "created_at": F.col("as_of_minute_ts"), "updated_at": F.col("as_of_minute_ts"),
        }
        return made.withColumns(extra)

    def stored(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Anomalies, risk and recommendations as tables, each computed once: what serving reads."""
        path, out = scratch_folder(self.spark), []
        for make in (lambda: self.hybrid, lambda: risk.decay_risk(out[0]), lambda: self.made(out[1])):
            df = make()
            df.write.parquet(f"{path}/{len(out)}")
            out.append(self.spark.read.schema(df.schema).parquet(f"{path}/{len(out)}"))
        return tuple(out)


def _shown(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Times as text, doubles rounded, counts as bigint."""
    out = []
    for c in columns or df.columns:
        kind = df.schema[c].dataType.typeName()
        x: Column = F.col(c)
        if kind == "timestamp":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            x = F.round(x + NUDGE, 6)
        elif kind in ("integer", "long"):
            x = x.cast("bigint")
        elif kind == "decimal":
            x = x.cast("double")
        out.append(x.alias(c))
    return df.select(*out)


def _query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Plant(spark, sf_dir))
        if sql:
            ORACLES[key] = CTES + sql
        return f

    return register


# ---- SQL of the tables -----------------------------------------------------

_T = "strftime({}, '%Y-%m-%d %H:%M:%S') AS {}"


def _ts(c: str = "minute_ts", alias: str | None = None) -> str:
    return _T.format(c, alias or c)


def _r(c: str, alias: str | None = None) -> str:
    return f"round({c} + {NUDGE}, 6) AS {alias or c}"


_AVERAGES = ", ".join(f"avg(value) FILTER (WHERE tag = '{t}') AS {c}" for t, c in SIGNALS.items())
_PROFILES = ", ".join(str(p) for p in telemetry.PROFILE_ROWS)
_DEFAULTS = ", ".join(f"coalesce({c}, {v!r}) AS {c}" for c, v in facts.PROFILE_DEFAULTS.items())


def _limit_sql(limit) -> str:
    op = "<" if limit.below else ">"
    return f"CASE WHEN {limit.column} {op} {limit.crit} THEN 2 WHEN {limit.column} {op} {limit.warn} THEN 1 END"


_LIMITS = " UNION ALL ".join(f"SELECT asset_id, minute_ts, '{x.anomaly_type}' AS anomaly_type, '{x.tag}' AS signal, {x.column} AS score, {_limit_sql(x)} AS severity FROM fact" for x in LIMITS)
_BASE = " + ".join(f"coalesce(10 * ({_limit_sql(x)}), 0)" for x in LIMITS)
_TYPES = ", ".join(f"CASE WHEN ({_limit_sql(x)}) IS NOT NULL THEN '{x.anomaly_type}' END" for x in LIMITS)
_BACK = "(PARTITION BY asset_id ORDER BY minute_ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND INTERVAL 1 SECOND PRECEDING)"
_ROWS = "(PARTITION BY asset_id ORDER BY minute_ts)"
_SPIKES = " UNION ALL ".join(
    f"SELECT asset_id, minute_ts, '{kind}' AS anomaly_type, '{signal}' AS signal, z AS score, CASE WHEN z >= {H.z_severe} THEN 3 ELSE 2 END AS severity FROM (SELECT *, ({p}_avg_15m - {p}_mean) / greatest(coalesce({p}_std, 0), {getattr(H, p + '_std_eps')}) AS z FROM ready WHERE {p}_n >= {H.min_rows_for_baseline}) WHERE z >= {H.z_warn}"
    for signal, p, kind, _ in detect._HYBRID
)
_DRIFTS = " UNION ALL ".join(
    f"SELECT asset_id, minute_ts, '{kind}' AS anomaly_type, '{signal}' AS signal, ({p}_s2 + {p}_s1 + {p}_slope_15m) / 3 AS score, CASE WHEN least({p}_s2, {p}_s1, {p}_slope_15m) >= {getattr(H, p + '_severe_slope')} THEN 3 ELSE 2 END AS severity FROM ready WHERE back2 = minute_ts - INTERVAL 2 MINUTE AND {p}_s2 IS NOT NULL AND {p}_s1 IS NOT NULL AND {p}_slope_15m IS NOT NULL AND least({p}_s2, {p}_s1, {p}_slope_15m) >= {getattr(H, p + '_drift_slope')}"
    for signal, p, _, kind in detect._HYBRID
)
_DROPS = f"SELECT asset_id, minute_ts, 'FLOW_DROP' AS anomaly_type, 'flow' AS signal, flow_drop_pct_15m AS score, CASE WHEN flow_drop_pct_15m <= {H.flow_drop_severe} THEN 3 ELSE 2 END AS severity FROM ready WHERE flow_drop_pct_15m <= {H.flow_drop}"
_POINTS = "CASE " + " ".join(f"WHEN anomaly_type = '{k}' THEN CASE WHEN severity >= 3 THEN {b} ELSE {a} END" for k, (a, b) in RiskOptions().points.items()) + " ELSE 5 END"
_HAS = "bool_or(anomaly_type = '{}')"
_MODE = f"CASE WHEN {_HAS.format('TEMP_DRIFT')} AND {_HAS.format('VIB_DRIFT')} THEN 'BEARING_WEAR' WHEN {_HAS.format('FLOW_DROP')} AND ({_HAS.format('VIB_SPIKE')} OR {_HAS.format('VIB_DRIFT')}) THEN 'CAVITATION' WHEN {_HAS.format('FLOW_DROP')} AND ({_HAS.format('CURRENT_DRIFT')} OR {_HAS.format('CURRENT_HIGH')}) THEN 'OVERLOAD' END"


def _rule_sql(value) -> str:
    parts = []
    for r in RULES:
        when = f"mode = '{r.mode}'" if r.mode else "mode NOT IN ('BEARING_WEAR', 'CAVITATION', 'OVERLOAD')"
        parts.append(f"WHEN {when}" + (f" AND risk_level = '{r.level}'" if r.level else "") + f" THEN {value(r)}")
    return "CASE " + " ".join(parts) + " END"


_SLOPE = "CASE WHEN count({0}) OVER q >= 2 THEN regr_slope({0}, epoch(minute_ts) / 60 - 28401120) OVER q END AS {1}"
CTES = f"""
WITH tel AS (
  SELECT ['COMP_001','FAN_001','GBX_001','PUMP_001','PUMP_002','EXTRA_001'][(user_id % 6) + 1] AS asset_id,
    CASE user_id % 6 WHEN 0 THEN 'Compressor' WHEN 1 THEN 'Fan' WHEN 2 THEN 'Gearbox' WHEN 3 THEN 'Pump' WHEN 4 THEN 'Pump' END AS asset_type,
    make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 60) AS ts,
    CASE event_type WHEN 'click' THEN 'temp_bearing_c' WHEN 'view' THEN 'vib_rms_mm_s' WHEN 'purchase' THEN 'motor_current_a' WHEN 'signup' THEN 'flow_rate_m3_h' ELSE 'discharge_pressure_bar' END AS tag,
    CASE event_type WHEN 'click' THEN 40+value*0.5 WHEN 'view' THEN 1+value*0.06 WHEN 'purchase' THEN 14+value*0.15 WHEN 'signup' THEN 125-value*0.6 ELSE 9-value*0.04 END AS value,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 64 ELSE 192 END AS quality,
    CAST(event_id AS BIGINT) AS kafka_offset, CAST(user_id % 6 AS INT) AS kafka_partition
  FROM events),
good AS (SELECT * FROM tel WHERE quality = 192),
prof(asset_id, location, asset_category, manufacturer, install_year, rated_capacity_pct, maintenance_interval_days, criticality, criticality_weight) AS (VALUES {_PROFILES}),
fact AS (SELECT asset_id, date_trunc('minute', ts) AS minute_ts, {_AVERAGES}, count(*) AS event_count FROM good GROUP BY ALL),
enr AS (SELECT fact.*, {_DEFAULTS} FROM fact LEFT JOIN prof USING (asset_id)),
lim AS (SELECT * FROM ({_LIMITS}) WHERE severity IS NOT NULL),
lrisk0 AS (SELECT *, least(CAST(round_even(({_BASE}) * CAST(criticality_weight AS DOUBLE), 0) AS DOUBLE), 100.0) AS risk_score FROM enr),
lrisk AS (SELECT asset_id, minute_ts, risk_score, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  coalesce({_TYPES}) AS failure_mode, nullif(concat_ws(',', {_TYPES}), '') AS top_drivers FROM lrisk0),
roll AS (SELECT asset_id, minute_ts, avg(avg_temp_c) OVER q AS temp_avg_15m, avg(avg_vib_mm_s) OVER q AS vib_avg_15m, avg(avg_current_a) OVER q AS current_avg_15m, avg(avg_flow_m3h) OVER q AS flow_avg_15m, avg(avg_pressure_bar) OVER q AS pressure_avg_15m,
  stddev_samp(avg_vib_mm_s) OVER h AS vib_std_60m, {_SLOPE.format('avg_temp_c', 'temp_slope_15m')}, {_SLOPE.format('avg_vib_mm_s', 'vib_slope_15m')}, {_SLOPE.format('avg_current_a', 'current_slope_15m')},
  CASE WHEN avg(avg_flow_m3h) OVER b > 0 THEN avg_flow_m3h / avg(avg_flow_m3h) OVER b - 1 END AS flow_drop_pct_15m, count(*) OVER h AS run_minutes_60m, event_count >= {MIN_EVENTS} AS quality_gate_ok
  FROM fact WINDOW q AS (PARTITION BY asset_id ORDER BY minute_ts RANGE BETWEEN INTERVAL 14 MINUTE PRECEDING AND CURRENT ROW), h AS (PARTITION BY asset_id ORDER BY minute_ts RANGE BETWEEN INTERVAL 59 MINUTE PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY asset_id ORDER BY minute_ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING)),
based AS (SELECT *, count(*) OVER {_BACK} AS lookback, lag(minute_ts, 2) OVER {_ROWS} AS back2,
  {', '.join(f'count({p}_avg_15m) OVER {_BACK} AS {p}_n, avg({p}_avg_15m) OVER {_BACK} AS {p}_mean, stddev_samp({p}_avg_15m) OVER {_BACK} AS {p}_std, lag({p}_slope_15m, 1) OVER {_ROWS} AS {p}_s1, lag({p}_slope_15m, 2) OVER {_ROWS} AS {p}_s2' for _, p, _, _ in detect._HYBRID)}
  FROM roll WHERE quality_gate_ok),
ready AS (SELECT * FROM based WHERE run_minutes_60m >= {H.min_run_minutes} AND lookback >= {H.min_rows_for_baseline}),
hyb AS ({_SPIKES} UNION ALL {_DRIFTS} UNION ALL {_DROPS}),
keys AS (SELECT DISTINCT asset_id, minute_ts FROM hyb),
win AS (SELECT keys.asset_id, keys.minute_ts, h.minute_ts AS at_ts, h.anomaly_type, {_POINTS} AS p, date_diff('minute', h.minute_ts, keys.minute_ts) AS age FROM keys JOIN hyb h ON h.asset_id = keys.asset_id AND h.minute_ts <= keys.minute_ts AND h.minute_ts > keys.minute_ts - INTERVAL 30 MINUTE),
scored AS (SELECT asset_id, minute_ts, CAST(least(CAST(round_even(sum(p * (30 - age)) / 30.0, 0) AS DOUBLE), 100.0) AS BIGINT) AS risk_score, {_MODE} AS failure_mode FROM win GROUP BY ALL),
counted AS (SELECT asset_id, minute_ts, anomaly_type, count(*) AS n, min(at_ts) AS first_at FROM win GROUP BY ALL),
tops AS (SELECT asset_id, minute_ts, string_agg(anomaly_type || 'x' || n, ', ' ORDER BY n DESC, first_at, anomaly_type) AS top_drivers FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, minute_ts ORDER BY n DESC, first_at, anomaly_type) AS rn FROM counted) WHERE rn <= 3 GROUP BY ALL),
drisk AS (SELECT asset_id, minute_ts, risk_score, CASE WHEN risk_score <= 29 THEN 'LOW' WHEN risk_score <= 69 THEN 'MED' ELSE 'HIGH' END AS risk_level, failure_mode, top_drivers FROM scored JOIN tops USING (asset_id, minute_ts)),
cur AS (SELECT asset_id, minute_ts AS as_of_minute_ts, risk_score, risk_level, failure_mode, top_drivers FROM drisk QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY minute_ts DESC) = 1),
recs0 AS (SELECT *, coalesce(failure_mode, 'UNKNOWN') AS mode FROM drisk),
recs AS (SELECT asset_id, minute_ts AS as_of_minute_ts, {_rule_sql(lambda r: f"'{r.rec_type}'")} AS rec_type, {_rule_sql(lambda r: r.priority)} AS priority, {_rule_sql(lambda r: r.confidence)} AS confidence,
  top_drivers AS drivers, minute_ts + to_hours(CASE risk_level WHEN 'HIGH' THEN 12 WHEN 'MED' THEN 24 ELSE 48 END) AS cooldown_until,
  mode || '|' || risk_level || '|' || CASE WHEN risk_score >= 90 THEN '90+' WHEN risk_score >= 70 THEN '70-89' WHEN risk_score >= 30 THEN '30-69' ELSE '0-29' END || '|' || trim(coalesce(top_drivers, '')) AS state_fingerprint,
  CASE (epoch(minute_ts) // 60) % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKED' ELSE 'CLOSED' END AS status FROM recs0 WHERE {_rule_sql(lambda r: r.priority)} IS NOT NULL)
"""

_FACT = ", ".join([*(_r(c) for c in SIGNALS.values()), "CAST(event_count AS BIGINT) AS event_count"])
_ANOMALY = f"asset_id, {_ts()}, anomaly_type, signal, {_r('score')}, CAST(severity AS BIGINT) AS severity"
_RISK = f"asset_id, {_ts()}, risk_score, risk_level, failure_mode, top_drivers"
ANOMALY = ["asset_id", "minute_ts", "anomaly_type", "signal", "score", "severity"]
RISK = ["asset_id", "minute_ts", "risk_score", "risk_level", "failure_mode", "top_drivers"]
_IN = f"minute_ts >= TIMESTAMP '{START}' AND minute_ts < TIMESTAMP '{END}'"


def _range():
    import datetime

    return datetime.datetime.fromisoformat(START), datetime.datetime.fromisoformat(END)


# ---- facts, features, anomalies ---------------------------------------------


@_query(f"SELECT asset_id, asset_type, {_ts('ts')}, tag, {_r('value')}, CAST(quality AS BIGINT) AS quality, kafka_offset FROM good")
def telemetry_good(p: Plant) -> DataFrame:
    return _shown(p.good.drop("kafka_partition"))


@_query(f"SELECT asset_id, {_ts()}, {_FACT} FROM fact")
def minute_fact(p: Plant) -> DataFrame:
    return _shown(p.facts.drop("fault_code_max"))


@_query(f"SELECT asset_id, {_ts()}, {_FACT}, location, asset_category, manufacturer, CAST(install_year AS BIGINT) AS install_year, CAST(rated_capacity_pct AS DOUBLE) AS rated_capacity_pct, CAST(maintenance_interval_days AS BIGINT) AS maintenance_interval_days, criticality, CAST(criticality_weight AS DOUBLE) AS criticality_weight FROM enr")
def minute_enriched(p: Plant) -> DataFrame:
    return _shown(p.enriched.drop("fault_code_max"))


@_query(f"SELECT asset_id, {_ts()}, CAST(CASE WHEN avg_temp_c > 80 THEN 1 ELSE 0 END + CASE WHEN avg_vib_mm_s > 5 THEN 2 ELSE 0 END + CASE WHEN avg_current_a > 28 THEN 4 ELSE 0 END + CASE WHEN avg_flow_m3h < 80 THEN 8 ELSE 0 END + CASE WHEN avg_pressure_bar < 6 THEN 16 ELSE 0 END AS BIGINT) AS fault_bits FROM fact")
def fault_bitmask(p: Plant) -> DataFrame:
    return _shown(facts.fault_bitmask(p.facts), ["asset_id", "minute_ts", "fault_bits"])


@_query(f"SELECT asset_id, {_ts()}, {_r('avg_temp_c', 'temp_avg_15m')}, {_r('avg_vib_mm_s', 'vib_avg_15m')}, {_r('avg_current_a', 'current_avg_15m')}, {_r('avg_flow_m3h', 'flow_avg_15m')}, {_r('avg_pressure_bar', 'pressure_avg_15m')}, CAST(event_count AS BIGINT) AS run_minutes_60m, event_count >= 5 AS quality_gate_ok FROM fact")
def features_minimal(p: Plant) -> DataFrame:
    return _shown(features.features_minimal(p.facts), ["asset_id", "minute_ts", *features.MEANS, "run_minutes_60m", "quality_gate_ok"])


_ROLLED = [*features.MEANS, "vib_std_60m", *features.SLOPES, "flow_drop_pct_15m"]


@_query(f"SELECT asset_id, {_ts()}, {', '.join(_r(c) for c in _ROLLED)}, CAST(run_minutes_60m AS BIGINT) AS run_minutes_60m, quality_gate_ok FROM roll")
def features_rolling(p: Plant) -> DataFrame:
    return _shown(p.rolling)


@_query(f"SELECT {_ANOMALY} FROM lim")
def anomalies_threshold(p: Plant) -> DataFrame:
    return _shown(p.limits, ANOMALY)


def _kinds(name: str, kinds: list[str]):
    @_query(f"SELECT {_ANOMALY} FROM hyb WHERE anomaly_type IN ({', '.join(map(repr, kinds))})", name)
    def run(p: Plant) -> DataFrame:
        return _shown(p.hybrid.filter(F.col("anomaly_type").isin(kinds)), ANOMALY)


_kinds("anomalies_zscore", ["VIB_SPIKE", "TEMP_HIGH", "CURRENT_HIGH"])
_kinds("anomalies_drift", ["VIB_DRIFT", "TEMP_DRIFT", "CURRENT_DRIFT"])
_kinds("anomalies_flow_drop", ["FLOW_DROP"])


@_query(f"SELECT {_ANOMALY} FROM hyb")
def anomalies_hybrid(p: Plant) -> DataFrame:
    return _shown(p.hybrid, ANOMALY)


@_query(f"SELECT asset_id, {_ts()}, count(*) AS n FROM hyb GROUP BY ALL")
def anomaly_minutes(p: Plant) -> DataFrame:
    return _shown(p.hybrid.groupBy("asset_id", "minute_ts").agg(F.count("*").alias("n")))


def _reason_sql(limit) -> str:
    # three places, halves up in the shortest decimal form, as the JVM formats doubles
    shown = f"CAST(CAST(round(CAST(CAST({limit.column} AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DECIMAL(18, 3)) AS VARCHAR)"
    word = "below" if limit.below else "exceeds"
    return f"SELECT asset_id, minute_ts, '{limit.anomaly_type}' AS anomaly_type, '{limit.tag}=' || {shown} || CASE {_limit_sql(limit)} WHEN 2 THEN ' {word} critical {limit.crit}' ELSE ' {word} warning {limit.warn}' END AS reason FROM fact WHERE {_limit_sql(limit)} IS NOT NULL"


@_query(f"SELECT asset_id, {_ts()}, anomaly_type, reason FROM ({' UNION ALL '.join(map(_reason_sql, LIMITS))})")
def anomaly_reasons(p: Plant) -> DataFrame:
    return _shown(p.limits, ["asset_id", "minute_ts", "anomaly_type", "reason"])


@_query(f"SELECT asset_id, {_ts('m', 'minute_ts')}, fault_code_max FROM (SELECT asset_id, date_trunc('minute', ts) AS m, max(CASE WHEN kafka_offset % 10 = 0 THEN kafka_offset % 7 END) AS fault_code_max FROM good GROUP BY ALL)")
def fault_codes(p: Plant) -> DataFrame:
    """The highest fault code of each minute; every tenth event also reports one."""
    code = (F.col("kafka_offset") % 7).cast("double") + 0.5
    reports = p.good.filter("kafka_offset % 10 = 0").withColumns({"tag": F.lit("fault_code"), "value": code})
    return _shown(facts.minute_facts(p.good.unionByName(reports)), ["asset_id", "minute_ts", "fault_code_max"])


# ---- messages ---------------------------------------------------------------

_KIND = "CASE kafka_offset % 97 WHEN 0 THEN 'malformed' WHEN 1 THEN 'bad timestamp' WHEN 2 THEN 'no asset' ELSE CASE WHEN quality <> 192 THEN 'quality' END END"


def _messages(p: Plant) -> DataFrame:
    """The telemetry as JSON messages, some of them broken."""
    kind = F.col("kafka_offset") % 97
    ts = F.when(kind == 1, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    body = F.to_json(F.struct(F.when(kind != 2, F.col("asset_id")).alias("asset_id"), "asset_type", ts.alias("ts"), "tag", "value", "quality"))
    return p.telemetry.select(F.when(kind == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("value"), F.col("kafka_offset").alias("offset"), F.col("kafka_partition").alias("partition"))


@_query(f"SELECT asset_id, asset_type, {_ts('ts')}, tag, {_r('value')}, kafka_offset FROM tel WHERE {_KIND} IS NULL")
def parsed_events(p: Plant) -> DataFrame:
    return _shown(telemetry.parse_events(_messages(p)), ["asset_id", "asset_type", "ts", "tag", "value", "kafka_offset"])


@_query(f"SELECT kafka_offset, CAST(kafka_partition AS BIGINT) AS kafka_partition, {_KIND} AS reason FROM tel WHERE {_KIND} IS NOT NULL")
def rejected_events(p: Plant) -> DataFrame:
    return _shown(telemetry.rejected_events(_messages(p)), ["kafka_offset", "kafka_partition", "reason"])


# ---- risk -------------------------------------------------------------------


@_query(
    f"""SELECT asset_id, {_ts()}, CAST(30 AS BIGINT) AS window_minutes, count(*) AS n_anomalies, count(DISTINCT anomaly_type) AS n_types, least(count(*), 50) AS n_listed,
  CASE WHEN count(*) <= 50 THEN CAST(sum(p) AS BIGINT) END AS points, CASE WHEN count(*) <= 50 THEN round(sum(p * (30 - age) / 30.0) + {NUDGE}, 6) END AS faded FROM win GROUP BY ALL"""
)
def risk_evidence(p: Plant) -> DataFrame:
    """What the evidence of decay risk says, read back from its JSON."""
    e = risk.read_evidence(p.decay)
    n = F.aggregate(F.map_values("evidence.driverCounts"), F.lit(0), lambda a, x: a + x)
    listed = F.col("evidence.contributions")
    points = F.aggregate(listed, F.lit(0).cast("bigint"), lambda a, x: a + x["basePoints"])
    faded = F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["basePoints"] * x["decay"])
    few = n <= RiskOptions().evidence_rows
    return _shown(e.select("asset_id", "minute_ts", F.col("evidence.windowMinutes").alias("window_minutes"), n.alias("n_anomalies"), F.size("evidence.driverCounts").alias("n_types"), F.size(listed).alias("n_listed"), F.when(few, points).alias("points"), F.when(few, faded).alias("faded")))


@_query(f"SELECT {_RISK} FROM lrisk")
def risk_threshold(p: Plant) -> DataFrame:
    return _shown(p.limit_risk, RISK)


@_query(f"SELECT {_RISK} FROM drisk")
def risk_decay(p: Plant) -> DataFrame:
    return _shown(p.decay, RISK)


@_query(f"SELECT f.asset_id, {_ts('f.minute_ts', 'minute_ts')}, CAST(coalesce((SELECT least(coalesce(CAST(round_even(sum({_POINTS} * (30 - date_diff('minute', h.minute_ts, f.minute_ts))) / 30.0, 0) AS DOUBLE), 0.0), 100.0) FROM hyb h WHERE h.asset_id = f.asset_id AND h.minute_ts <= f.minute_ts AND h.minute_ts > f.minute_ts - INTERVAL 30 MINUTE), 0) AS BIGINT) AS risk_score FROM fact f")
def risk_decay_dense(p: Plant) -> DataFrame:
    return _shown(risk.decay_risk(p.hybrid, minutes=p.facts), ["asset_id", "minute_ts", "risk_score"])


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, risk_score, risk_level, failure_mode, top_drivers FROM cur")
def risk_current(p: Plant) -> DataFrame:
    return _shown(risk.current_risk(p.decay).drop("evidence_json"))


@_query(f"SELECT asset_id, {_ts()}, top_drivers FROM tops")
def top_drivers(p: Plant) -> DataFrame:
    return _shown(p.decay, ["asset_id", "minute_ts", "top_drivers"])


@_query("SELECT asset_id, failure_mode, count(*) AS n FROM drisk GROUP BY ALL")
def failure_mode(p: Plant) -> DataFrame:
    return p.decay.groupBy("asset_id", "failure_mode").agg(F.count("*").alias("n"))


@_query("SELECT asset_id, risk_score, CASE WHEN risk_score >= 80 THEN 'HIGH' WHEN risk_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS ui_badge, CASE WHEN risk_score >= 90 THEN 'CRITICAL' WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS panel_badge FROM cur")
def risk_badges(p: Plant) -> DataFrame:
    return _shown(risk.current_risk(p.decay).select("asset_id", "risk_score", ui_badge(F.col("risk_score")).alias("ui_badge"), dashboard_band(F.col("risk_score")).alias("panel_badge")))


@_query("SELECT anomaly_type, CASE WHEN severity >= 4 THEN 'critical' WHEN severity >= 3 THEN 'warning' ELSE 'info' END AS badge, count(*) AS n FROM hyb GROUP BY ALL")
def severity_badges(p: Plant) -> DataFrame:
    return p.hybrid.groupBy("anomaly_type", severity_badge(F.col("severity")).alias("badge")).agg(F.count("*").alias("n"))


# ---- recommendations --------------------------------------------------------

_REC = ["asset_id", "as_of_minute_ts", "rec_type", "priority", "confidence", "drivers", "cooldown_until"]


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, rec_type, CAST(priority AS BIGINT) AS priority, CAST(confidence AS DOUBLE) AS confidence, drivers, {_ts('cooldown_until')} FROM recs")
def recommendations(p: Plant) -> DataFrame:
    return _shown(p.recs, _REC)


@_query("SELECT state_fingerprint, count(*) AS n FROM recs GROUP BY ALL")
def fingerprints(p: Plant) -> DataFrame:
    return p.recs.groupBy("state_fingerprint").agg(F.count("*").alias("n"))


@_query(f"SELECT asset_id, rec_type, {_ts('max(as_of_minute_ts)', 'as_of_minute_ts')} FROM recs WHERE status <> 'CLOSED' GROUP BY asset_id, rec_type")
def latest_active(p: Plant) -> DataFrame:
    return _shown(serving.latest_active(p.recs), ["asset_id", "rec_type", "as_of_minute_ts"])


@_query(f"SELECT asset_id, {_ts('minute_ts', 'as_of_minute_ts')}, mode, risk_score, risk_level, coalesce(top_drivers, '') AS drivers FROM recs0 WHERE {_rule_sql(lambda r: r.priority)} IS NOT NULL")
def rec_evidence(p: Plant) -> DataFrame:
    """Evidence of recommendations written as JSON and read back."""
    back = recommend.read_evidence(recommend.write_evidence(p.recs))
    return _shown(back.select("asset_id", "as_of_minute_ts", "evidence.mode", "evidence.risk_score", "evidence.risk_level", "evidence.drivers"))


_HOURS = (3, 6, 9, 12)


def _family_sql(mode: str) -> str:
    return f"CASE {mode} " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in FAMILIES.items()) + f" ELSE '{GENERAL_FAMILY}' END"


def _lifecycle_sql(clock: str = "TIMESTAMP '2024-01-01 {:02}:00:00'", commands: bool = True) -> str:
    """The table after each snapshot as a CTE of its own; one key a state, as ids are hashes."""
    known = " OR ".join(f"starts_with(rec_type, '{f}')" for f in (*FAMILIES.values(), GENERAL_FAMILY))
    steps = ["life AS (SELECT '' AS rid, asset_id, rec_type, status, as_of_minute_ts, as_of_minute_ts AS created_at, as_of_minute_ts AS updated_at, '' AS closed_by, as_of_minute_ts AS ack_until, state_fingerprint FROM recs WHERE false)"]
    table = "life"
    for i, hour in enumerate(_HOURS):
        now = clock.format(hour)
        steps.append(f"""snap{i} AS MATERIALIZED (SELECT *, risk_level = 'LOW' OR risk_score < 30 OR mode = 'UNKNOWN' AS resolved FROM (SELECT * FROM recs0 WHERE minute_ts < TIMESTAMP '2024-01-01 {hour:02}:00:00' QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY minute_ts DESC) = 1)),
held{i} AS (SELECT * FROM {table} WHERE status <> 'CLOSED' QUALIFY row_number() OVER (PARTITION BY asset_id, rec_type ORDER BY created_at DESC, rid DESC) = 1),
made{i} AS (SELECT s.asset_id, s.mode, r.* EXCLUDE (asset_id) FROM snap{i} s JOIN recs r ON r.asset_id = s.asset_id AND r.as_of_minute_ts = s.minute_ts WHERE NOT resolved),
turn{i} AS MATERIALIZED (SELECT m.*, concat_ws('|', m.asset_id, m.rec_type, m.as_of_minute_ts, m.state_fingerprint) AS rid, h.rid AS held,
  coalesce(h.status = 'ACKED' AND m.as_of_minute_ts < h.ack_until, false) OR coalesce(upper(h.state_fingerprint) = upper(m.state_fingerprint), false) AS skip,
  CASE WHEN h.rid IS NOT NULL THEN nullif({_family_sql("upper(split_part(h.state_fingerprint, '|', 1))")}, {_family_sql("m.mode")}) END AS turned
  FROM made{i} m LEFT JOIN held{i} h ON h.asset_id = m.asset_id AND h.rec_type = m.rec_type),
shut{i} AS (SELECT *, status <> 'CLOSED' AND (asset_id IN (SELECT asset_id FROM snap{i} WHERE resolved) AND ({known})
  OR EXISTS (SELECT 1 FROM turn{i} t WHERE t.asset_id = l.asset_id AND starts_with(l.rec_type, t.turned)) OR rid IN (SELECT held FROM turn{i} WHERE NOT skip AND held IS NOT NULL)) AS shut FROM {table} l),
life{i} AS MATERIALIZED (SELECT rid, asset_id, rec_type, CASE WHEN shut THEN 'CLOSED' ELSE status END AS status, as_of_minute_ts, created_at, CASE WHEN shut THEN {now} ELSE updated_at END AS updated_at, CASE WHEN shut THEN 'system' ELSE closed_by END AS closed_by, ack_until, state_fingerprint FROM shut{i}
  UNION ALL SELECT rid, asset_id, rec_type, 'OPEN', as_of_minute_ts, {now}, {now}, NULL, NULL, state_fingerprint FROM turn{i} WHERE NOT skip AND rid NOT IN (SELECT rid FROM {table}))""")
        table = f"life{i}"
        if commands and i == 1:
            steps.append(f"""told AS MATERIALIZED (SELECT rid, asset_id, rec_type, CASE WHEN status <> 'OPEN' THEN status WHEN asset_id < 'G' THEN 'ACKED' ELSE 'CLOSED' END AS status, as_of_minute_ts, created_at, CASE WHEN status = 'OPEN' THEN {now} ELSE updated_at END AS updated_at,
  CASE WHEN status = 'OPEN' AND asset_id >= 'G' THEN 'operator' ELSE closed_by END AS closed_by, CASE WHEN status = 'OPEN' AND asset_id < 'G' THEN {now} + INTERVAL 1 DAY ELSE ack_until END AS ack_until, state_fingerprint FROM {table})""")
            table = "told"
    times = ", ".join(_ts(c) for c in ("as_of_minute_ts", "created_at", "updated_at", "ack_until"))
    return ", " + ",\n".join(steps) + f" SELECT asset_id, rec_type, status, {times}, closed_by FROM {table} l"


@_query(_lifecycle_sql())
def rec_lifecycle(p: Plant) -> DataFrame:
    """Four snapshots of current risk in turn, with commands between them."""
    path = scratch_folder(p.spark)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return p.spark.read.schema(df.schema).parquet(f"{path}/{name}")

    minutes = stored(p.decay, "risk")
    recs = p.spark.createDataFrame([], schemas.RECOMMENDATIONS)
    for i, hour in enumerate(_HOURS):
        now = F.expr(f"timestamp'2024-01-01 00:00:00' + interval {hour} hours")
        snapshot = risk.current_risk(minutes.filter(F.col("minute_ts") < now))
        recs = stored(recommend.reconcile(recs, snapshot, now), f"recs{i}")
        if i == 1:
            commands = recs.filter("status = 'OPEN'").select("recommendation_id", F.when(F.col("asset_id") < "G", "ack").otherwise("close").alias("action"), F.lit("operator").alias("by"), F.lit("seen").alias("note_or_reason"), F.lit(None).cast("timestamp").alias("ack_until"))
            recs = stored(recommend.apply_commands(recs, commands, now), "told")
    return _shown(recs, ["asset_id", "rec_type", "status", "as_of_minute_ts", "created_at", "updated_at", "closed_by", "ack_until"])


_NOON_SQL = "TIMESTAMP '2024-01-01 06:00:00'"
_GIVEN = "CASE WHEN asset_id < 'D' THEN 'ACK' WHEN asset_id < 'G' THEN 'CLOSE' ELSE '' END"
_TAKES = f"({_GIVEN} = 'ACK' AND status IN ('OPEN', 'ACKED'))"
_SHUTS = f"(({_GIVEN} = 'CLOSE' OR asset_id = 'PUMP_001') AND status <> 'CLOSED')"


@_query(
    f"""SELECT asset_id, rec_type, {_ts('as_of_minute_ts')}, CASE WHEN {_TAKES} THEN 'ACKED' WHEN {_SHUTS} THEN 'CLOSED' ELSE status END AS status,
  CASE WHEN {_TAKES} THEN strftime({_NOON_SQL} + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS ack_until, CASE WHEN {_TAKES} THEN 'shift' END AS acked_by, CASE WHEN {_TAKES} THEN 'seen' END AS ack_note,
  CASE WHEN NOT {_SHUTS} THEN NULL WHEN asset_id = 'PUMP_001' THEN 'lead' ELSE 'shift' END AS closed_by, CASE WHEN NOT {_SHUTS} THEN NULL WHEN asset_id = 'PUMP_001' THEN 'overhaul' ELSE 'done' END AS close_reason FROM recs"""
)
def rec_commands(p: Plant) -> DataFrame:
    """Acknowledged, closed and all closed by command, with the notes that
    commands leave in the evidence (written as JSON and read back)."""
    now = F.expr("timestamp'2024-01-01 06:00:00'")
    given = F.when(F.col("asset_id") < "D", "ack").when(F.col("asset_id") < "G", "close")
    told = p.recs.select("recommendation_id", given.alias("action"), F.lit("shift").alias("by"), F.when(given == "ack", "seen").otherwise("done").alias("note_or_reason"), F.lit(None).cast("timestamp").alias("ack_until")).filter("action is not null")
    recs = recommend.close_all(recommend.apply_commands(p.recs, told, now), ["PUMP_001"], "lead", "overhaul", now)
    back = recommend.read_evidence(recommend.write_evidence(recs))
    return _shown(back.select("asset_id", "rec_type", "as_of_minute_ts", "status", "ack_until", "evidence.acked_by", "evidence.ack_note", "closed_by", "evidence.close_reason"))


# ---- serving ----------------------------------------------------------------


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, risk_score, risk_level FROM cur ORDER BY asset_id LIMIT 100")
def list_assets(p: Plant) -> DataFrame:
    return _shown(serving.list_assets(risk.current_risk(p.decay)))


@_query("SELECT cur.asset_id, risk_score, risk_level, count(*) FILTER (WHERE status = 'OPEN') AS open_recommendations, count(*) FILTER (WHERE status = 'ACKED') AS acked_recommendations FROM cur LEFT JOIN recs ON recs.asset_id = cur.asset_id GROUP BY ALL")
def asset_summary(p: Plant) -> DataFrame:
    _, scored, recs = p.stored()
    return _shown(serving.asset_summary(risk.current_risk(scored), recs), ["asset_id", "risk_score", "risk_level", "open_recommendations", "acked_recommendations"])


def _series(step: int):
    bucket = "minute_ts" if step == 1 else f"time_bucket(INTERVAL {step} MINUTE, minute_ts)"
    sql = f"SELECT asset_id, {_ts('b', 'minute_ts')}, max(risk_score) AS risk_score, max(risk_level) AS risk_level, max(failure_mode) AS failure_mode FROM (SELECT *, {bucket} AS b FROM drisk WHERE {_IN}) GROUP BY asset_id, b"

    @_query(sql, f"risk_series_{step}m")
    def run(p: Plant) -> DataFrame:
        return _shown(serving.risk_series(p.decay, None, *_range(), step), ["asset_id", "minute_ts", "risk_score", "risk_level", "failure_mode"])


for _step in (1, 5, 15):
    _series(_step)


@_query(f"SELECT {_ANOMALY} FROM hyb h WHERE {_IN} ORDER BY h.minute_ts, asset_id, anomaly_type LIMIT 500")
def anomalies_in_range(p: Plant) -> DataFrame:
    return _shown(serving.anomalies_in_range(p.hybrid, None, *_range()), ANOMALY)


@_query(f"SELECT {_ANOMALY} FROM hyb h WHERE {_IN} ORDER BY h.minute_ts, asset_id, anomaly_type LIMIT 2000")
def anomalies_clamped(p: Plant) -> DataFrame:
    """More rows asked for than a page may have."""
    return _shown(serving.anomalies_in_range(p.hybrid, None, *_range(), take=1_000_000), ANOMALY)


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, rec_type, status FROM recs r WHERE status IN ('OPEN', 'ACKED') ORDER BY r.as_of_minute_ts DESC, asset_id, rec_type LIMIT 50")
def rec_queue(p: Plant) -> DataFrame:
    return _shown(serving.rec_queue(p.recs, " active "), ["asset_id", "as_of_minute_ts", "rec_type", "status"])


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, rec_type, status FROM recs r WHERE status = 'OPEN' ORDER BY r.as_of_minute_ts DESC, asset_id, rec_type LIMIT 100")
def asset_recs(p: Plant) -> DataFrame:
    return _shown(serving.asset_recs(p.recs, None, "open"), ["asset_id", "as_of_minute_ts", "rec_type", "status"])


@_query(
    f"""SELECT c.asset_id, s.latest_score, s.latest_level, coalesce(s.trend, 'unknown') AS trend, s.min_score, s.max_score, round(s.avg_score + {NUDGE}, 6) AS avg_score,
  (SELECT least(count(*), 20) FROM hyb WHERE hyb.asset_id = c.asset_id AND {_IN}) AS n_anomalies, (SELECT least(count(*), 10) FROM recs WHERE recs.asset_id = c.asset_id AND status = 'OPEN') AS n_recs
FROM cur c LEFT JOIN (SELECT asset_id, arg_max(risk_score, minute_ts) AS latest_score, arg_max(risk_level, minute_ts) AS latest_level,
  CASE WHEN arg_max(risk_score, minute_ts) - arg_min(risk_score, minute_ts) > 10 THEN 'rising' WHEN arg_max(risk_score, minute_ts) - arg_min(risk_score, minute_ts) < -10 THEN 'falling' ELSE 'flat' END AS trend,
  min(risk_score) AS min_score, max(risk_score) AS max_score, avg(risk_score) AS avg_score FROM drisk WHERE {_IN} GROUP BY asset_id) s USING (asset_id)"""
)
def insight_facts(p: Plant) -> DataFrame:
    found, scored, recs = p.stored()
    df = serving.insight_facts(risk.current_risk(scored), recs, scored, found, *_range())
    df = df.withColumns({"n_anomalies": F.coalesce(F.size("anomalies"), F.lit(0)), "n_recs": F.coalesce(F.size("recommendations"), F.lit(0))})
    return _shown(df, ["asset_id", "latest_score", "latest_level", "trend", "min_score", "max_score", "avg_score", "n_anomalies", "n_recs"])


_LISTED = "strftime({}, '%Y-%m-%d %H:%M:%S') || ' ' || {}"


@_query(
    f"""SELECT c.asset_id, coalesce(a.anomalies, '') AS anomalies, coalesce(r.recommendations, '') AS recommendations FROM cur c
LEFT JOIN (SELECT asset_id, string_agg({_LISTED.format('minute_ts', 'anomaly_type')}, ', ' ORDER BY minute_ts DESC, anomaly_type) AS anomalies FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY minute_ts DESC, anomaly_type) AS rn FROM hyb WHERE {_IN}) WHERE rn <= 20 GROUP BY asset_id) a USING (asset_id)
LEFT JOIN (SELECT asset_id, string_agg(rec_type || ' ' || priority, ', ' ORDER BY as_of_minute_ts DESC) AS recommendations FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY as_of_minute_ts DESC) AS rn FROM recs WHERE status = 'OPEN') WHERE rn <= 10 GROUP BY asset_id) r USING (asset_id)"""
)
def insight_lists(p: Plant) -> DataFrame:
    """The two lists of the insight facts, item by item."""
    found, scored, recs = p.stored()
    df = serving.insight_facts(risk.current_risk(scored), recs, scored, found, *_range())
    listed = {
        "anomalies": F.transform("anomalies", lambda x: F.concat(F.date_format(x["minute_ts"], "yyyy-MM-dd HH:mm:ss"), F.lit(" "), x["anomaly_type"])),
        "recommendations": F.transform("recommendations", lambda x: F.concat(x["rec_type"], F.lit(" "), x["priority"].cast("string"))),
    }
    return df.select("asset_id", *[F.coalesce(F.array_join(x, ", "), F.lit("")).alias(c) for c, x in listed.items()])


@_query(f"SELECT l.asset_id, {_ts('l.minute_ts', 'minute_ts')}, l.risk_score, EXISTS (SELECT 1 FROM hyb WHERE hyb.asset_id = l.asset_id AND hyb.minute_ts = l.minute_ts) AS has_anomaly FROM lrisk l")
def risk_markers(p: Plant) -> DataFrame:
    return _shown(serving.risk_markers(p.limit_risk, p.hybrid), ["asset_id", "minute_ts", "risk_score", "has_anomaly"])


@_query("SELECT asset_id AS metric, risk_score AS value FROM cur")
def panel_score_by_asset(p: Plant) -> DataFrame:
    return _shown(serving.panel_score_by_asset(risk.current_risk(p.decay)))


@_query(f"SELECT asset_id, risk_score, risk_level, failure_mode, top_drivers, {_ts('as_of_minute_ts')} FROM cur")
def panel_levels(p: Plant) -> DataFrame:
    return _shown(serving.panel_levels(risk.current_risk(p.decay)))


def _panel(name: str, table: str, column: str, pick):
    @_query(f"SELECT {_ts('minute_ts', 'time')}, asset_id AS metric, {_r(column, 'value')} FROM {table} WHERE {_IN}", name)
    def run(p: Plant) -> DataFrame:
        return _shown(serving.panel_series(pick(p), column, None, *_range()))


_panel("panel_temperature", "fact", "avg_temp_c", lambda p: p.facts)
_panel("panel_vibration", "fact", "avg_vib_mm_s", lambda p: p.facts)
_panel("panel_risk", "lrisk", "risk_score", lambda p: p.limit_risk)


@_query(f"SELECT {_ANOMALY} FROM lim l WHERE {_IN} ORDER BY l.minute_ts DESC, asset_id, anomaly_type LIMIT 100")
def panel_anomalies(p: Plant) -> DataFrame:
    return _shown(serving.panel_anomalies(p.limits, None, *_range()), ANOMALY)


#: Newest anomalies first, assets by name, newest recommendations first.
_NEWEST, _BY_ASSET, _QUEUE = ("-minute_ts", "asset_id", "anomaly_type"), ("asset_id",), ("-as_of_minute_ts", "asset_id", "rec_type", "recommendation_id")


def _second_page(p: Plant, df: DataFrame, order: tuple[str, ...], take: int, rows: int) -> DataFrame:
    """The page after the first one's last row, from a table in page order."""
    path = scratch_folder(p.spark)
    pages.write_pages(df, path, order, rows)
    last = pages.read_page(p.spark, path, order, take).collect()[-1]
    return pages.read_page(p.spark, path, order, take, tuple(last[c.lstrip("-")] for c in order))


@_query(f"SELECT {_ANOMALY} FROM hyb h ORDER BY h.minute_ts DESC, asset_id, anomaly_type LIMIT 100 OFFSET 100")
def anomaly_page(p: Plant) -> DataFrame:
    return _shown(_second_page(p, p.hybrid, _NEWEST, 100, 400), ANOMALY)


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, risk_score, risk_level FROM cur ORDER BY asset_id LIMIT 2 OFFSET 2")
def asset_page(p: Plant) -> DataFrame:
    return _shown(_second_page(p, risk.current_risk(p.decay), _BY_ASSET, 2, 1).select("asset_id", "as_of_minute_ts", "risk_score", "risk_level"))


@_query(f"SELECT asset_id, {_ts('as_of_minute_ts')}, rec_type, status FROM recs r WHERE status IN ('OPEN', 'ACKED') ORDER BY r.as_of_minute_ts DESC, asset_id, rec_type LIMIT 50 OFFSET 50")
def rec_page(p: Plant) -> DataFrame:
    return _shown(_second_page(p, p.recs.filter("status in ('OPEN', 'ACKED')").drop("evidence"), _QUEUE, 50, 100), ["asset_id", "as_of_minute_ts", "rec_type", "status"])


@_query("SELECT DISTINCT asset_id FROM cur")
def panel_assets(p: Plant) -> DataFrame:
    return serving.panel_assets(risk.current_risk(p.decay))


@_query("SELECT 'telemetry_raw' AS table_name, count(*) AS n_rows FROM good UNION ALL SELECT 'asset_minute_fact', count(*) FROM fact UNION ALL SELECT 'asset_anomaly_events', count(*) FROM lim UNION ALL SELECT 'asset_risk_minute', count(*) FROM lrisk UNION ALL SELECT 'asset_enriched_minute', count(*) FROM enr")
def report_counts(p: Plant) -> DataFrame:
    return serving.report_counts({"telemetry_raw": p.good, "asset_minute_fact": p.facts, "asset_anomaly_events": p.limits, "asset_risk_minute": p.limit_risk, "asset_enriched_minute": p.enriched})


@_query(f"SELECT asset_id, asset_type, {_ts('ts')}, tag, round(value, 2) AS value, CAST(quality AS BIGINT) AS quality FROM good g ORDER BY g.ts DESC, kafka_offset DESC LIMIT 5")
def report_raw(p: Plant) -> DataFrame:
    return _shown(serving.report_raw(p.good))


@_query(f"SELECT asset_id, {_ts()}, round(avg_temp_c, 1) AS avg_temp_c, round(avg_vib_mm_s, 3) AS avg_vib_mm_s, round(avg_current_a, 2) AS avg_current_a, round(avg_flow_m3h, 2) AS avg_flow_m3h, event_count FROM fact f ORDER BY f.minute_ts DESC, asset_id LIMIT 10")
def report_facts(p: Plant) -> DataFrame:
    return _shown(serving.report_facts(p.facts))


@_query(f"SELECT asset_id, {_ts()}, anomaly_type, signal, CAST(severity AS BIGINT) AS severity, round(score, 2) AS score FROM lim l ORDER BY l.minute_ts DESC, asset_id, anomaly_type LIMIT 10")
def report_anomalies(p: Plant) -> DataFrame:
    return _shown(serving.report_anomalies(p.limits))


@_query(f"SELECT asset_id, {_ts()}, round(risk_score, 1) AS risk_score, risk_level, failure_mode, top_drivers FROM lrisk l ORDER BY l.minute_ts DESC, asset_id LIMIT 10")
def report_risk(p: Plant) -> DataFrame:
    return _shown(serving.report_risk(p.limit_risk))


@_query(f"SELECT asset_id, {_ts()}, round(avg_temp_c, 1) AS avg_temp_c, round(avg_vib_mm_s, 3) AS avg_vib_mm_s, location, asset_category, manufacturer, criticality, CAST(criticality_weight AS DOUBLE) AS criticality_weight, CAST(maintenance_interval_days AS BIGINT) AS maintenance_interval_days FROM enr e ORDER BY e.minute_ts DESC, asset_id LIMIT 10")
def report_enriched(p: Plant) -> DataFrame:
    return _shown(serving.report_enriched(p.enriched))


@_query(f"SELECT f.asset_id, {_ts('f.minute_ts', 'minute_ts')}, {_r('f.avg_temp_c', 'avg_temp_c')}, c.risk_score, c.risk_level FROM fact f JOIN cur c ON f.asset_id = c.asset_id")
def fact_join_risk(p: Plant) -> DataFrame:
    return _shown(serving.ops_fact_risk(p.facts, risk.current_risk(p.decay)), ["asset_id", "minute_ts", "avg_temp_c", "risk_score", "risk_level"])


@_query("SELECT asset_id, count(*) AS n_rows FROM fact GROUP BY ALL")
def rows_per_asset(p: Plant) -> DataFrame:
    return serving.ops_rows_per_asset(p.facts)


# ---- sinks and streams ------------------------------------------------------

_NOON = "TIMESTAMP '2024-01-01 06:00:00'"


@_query(f"SELECT asset_id, {_ts('max(minute_ts)', 'as_of_minute_ts')} FROM lrisk GROUP BY asset_id")
def upsert_risk(p: Plant) -> DataFrame:
    """Morning states brought up to date by afternoon ones, and by late morning ones."""
    day = p.limit_risk
    noon = F.expr("timestamp'2024-01-01 06:00:00'")
    morning, all_day = risk.current_risk(day.filter(F.col("minute_ts") < noon)), risk.current_risk(day)
    state = sinks.upsert(morning, all_day, ["asset_id"], "as_of_minute_ts")
    return _shown(sinks.upsert(state, morning, ["asset_id"], "as_of_minute_ts"), ["asset_id", "as_of_minute_ts"])


@_query(f"SELECT {_ANOMALY} FROM lim WHERE minute_ts >= {_NOON}")
def insert_new_anomalies(p: Plant) -> DataFrame:
    """Only those of the day that the morning's table lacks."""
    found = p.limits
    morning = found.filter(F.col("minute_ts") < F.expr("timestamp'2024-01-01 06:00:00'"))
    return _shown(sinks.insert_new(morning, found, ["asset_id", "minute_ts", "anomaly_type", "signal"]), ANOMALY)


@_query(f"SELECT asset_id, {_ts()}, anomaly_type FROM lim WHERE minute_ts > {_NOON}")
def incremental_scan(p: Plant) -> DataFrame:
    import datetime

    return _shown(telemetry.incremental(p.limits, "minute_ts", datetime.datetime(2024, 1, 1, 6)), ["asset_id", "minute_ts", "anomaly_type"])


@_query(f"SELECT asset_id, {_ts()}, risk_score FROM drisk d JOIN (SELECT DISTINCT asset_id AS a FROM cur) ON asset_id = a WHERE d.minute_ts >= TIMESTAMP '2024-01-01 08:00:00' AND d.minute_ts <= TIMESTAMP '2024-01-01 09:53:00'")
def recompute_late(p: Plant) -> DataFrame:
    """Decay risk that a correction of 08:00 to 08:15 may change, from near history alone."""
    late = p.facts.filter(F.col("minute_ts").between(F.expr("timestamp'2024-01-01 08:00:00'"), F.expr("timestamp'2024-01-01 08:15:00'")))
    whole = p.facts.select("asset_id").distinct().select("asset_id", F.explode(F.expr("array(timestamp'2024-01-01 08:00:00', timestamp'2024-01-01 08:15:00')")).alias("minute_ts"))
    return _shown(jobs.recompute(p.facts, whole.unionByName(late.select("asset_id", "minute_ts")), MIN_EVENTS)["risk"], ["asset_id", "minute_ts", "risk_score"])


_CLOSED = "minute_ts + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM good)"
_ONCE = {"availableNow": True}


def _event_stream(p: Plant) -> DataFrame:
    schema = p.spark.read.parquet(f"{p.sf_dir}/events.parquet").schema
    return telemetry.good_events(telemetry.telemetry_from_events(p.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(p.sf_dir)))


@_query(f"SELECT asset_id, {_ts()}, {_FACT} FROM fact WHERE {_CLOSED}")
def stream_minute_fact(p: Plant) -> DataFrame:
    """Closed minutes of one streaming pass over the events."""
    path = scratch_folder(p.spark)
    jobs.start_facts(_event_stream(p), f"{path}/facts", f"{path}/checkpoint", trigger=_ONCE).awaitTermination()
    return _shown(p.spark.read.schema(p.facts.schema).parquet(f"{path}/facts").drop("fault_code_max", "event_date"))


@_query(f"SELECT asset_id, {_ts()}, risk_score, risk_level, top_drivers, location, criticality, CAST(event_count AS BIGINT) AS event_count FROM lrisk JOIN (SELECT asset_id, minute_ts, location, criticality, event_count FROM enr) e USING (asset_id, minute_ts) WHERE {_CLOSED}")
def stream_analytics(p: Plant) -> DataFrame:
    """Risk and enriched minutes as the analytics stream's fan-out writes them."""
    path = scratch_folder(p.spark)
    analytics.start_analytics(_event_stream(p), p.profiles, path, f"{path}/checkpoint", trigger=_ONCE).awaitTermination()
    scored, enriched = (sinks.read_batches(p.spark, f"{path}/{t}").drop("batch_id") for t in ("risk", "enriched"))
    joined = scored.join(enriched.select("asset_id", "minute_ts", "location", "criticality", "event_count"), ["asset_id", "minute_ts"])
    return _shown(joined, ["asset_id", "minute_ts", "risk_score", "risk_level", "top_drivers", "location", "criticality", "event_count"])


@_query(f"SELECT asset_id, {_ts()}, risk_score, risk_level, failure_mode, top_drivers FROM drisk WHERE {_CLOSED}")
def stream_chain(p: Plant) -> DataFrame:
    """Decay risk as the consumers behind the facts stream write it."""
    path = scratch_folder(p.spark)
    jobs.start_facts(_event_stream(p), f"{path}/facts", f"{path}/checkpoint", trigger=_ONCE).awaitTermination()
    analytics.start_chain(p.spark, f"{path}/facts", path, f"{path}/checkpoint_chain", MIN_EVENTS, _ONCE).awaitTermination()
    return _shown(analytics.chain_table(p.spark, path, "risk"), RISK)


def _chain_in_steps(p: Plant, parts: list[Column]) -> str:
    """The chain over facts that arrive in parts, a restart after each; where it wrote."""
    path = scratch_folder(p.spark)
    with sized_caches(p.spark):
        rows = p.facts.withColumn("event_date", F.to_date("minute_ts")).persist()
    try:
        for part in parts:
            rows.filter(part).write.mode("append").partitionBy("event_date").parquet(f"{path}/facts")
            analytics.start_chain(p.spark, f"{path}/facts", path, f"{path}/checkpoint", MIN_EVENTS, _ONCE).awaitTermination()
    finally:
        rows.unpersist()
    return path


#: Minutes that come late, all over the day.
_LATE = "floor(unix_seconds(minute_ts) / 60) % 7 = 3"


@_query(
    f"""SELECT 'anomalies' AS table_name, asset_id, {_ts()}, anomaly_type AS what, CAST(severity AS BIGINT) AS n FROM hyb
UNION ALL SELECT 'risk', asset_id, {_ts()}, risk_level || ' ' || top_drivers, CAST(risk_score AS BIGINT) FROM drisk
UNION ALL SELECT 'current', asset_id, {_ts('as_of_minute_ts', 'minute_ts')}, risk_level || ' ' || top_drivers, CAST(risk_score AS BIGINT) FROM cur"""
)
def chain_late(p: Plant) -> DataFrame:
    """Anomalies, risk and current states after minutes that arrive late correct them."""
    noon = "minute_ts < timestamp'2024-01-01 06:00:00'"
    path = _chain_in_steps(p, [F.expr(f"not {_LATE} and {noon}"), F.expr(f"not {_LATE} and not {noon}"), F.expr(_LATE)])
    table = lambda name: analytics.chain_table(p.spark, path, name)
    level = F.concat_ws(" ", "risk_level", "top_drivers")
    rows = table("anomalies").select(F.lit("anomalies").alias("table_name"), "asset_id", "minute_ts", F.col("anomaly_type").alias("what"), F.col("severity").cast("bigint").alias("n"))
    rows = rows.unionByName(table("risk").select(F.lit("risk").alias("table_name"), "asset_id", "minute_ts", level.alias("what"), F.col("risk_score").cast("bigint").alias("n")))
    rows = rows.unionByName(table("current").select(F.lit("current").alias("table_name"), "asset_id", F.col("as_of_minute_ts").alias("minute_ts"), level.alias("what"), F.col("risk_score").cast("bigint").alias("n")))
    return _shown(rows)


def _hours_of_facts() -> list[Column]:
    hour = lambda h: F.expr(f"timestamp'2024-01-01 00:00:00' + interval {h} hours")
    return [(F.col("minute_ts") >= hour(a)) & (F.col("minute_ts") < hour(b)) for a, b in zip((0, *_HOURS[:-1]), _HOURS)]


@_query(_lifecycle_sql("(SELECT max(minute_ts) FROM fact WHERE minute_ts < TIMESTAMP '2024-01-01 {:02}:00:00')", commands=False))
def chain_lifecycle(p: Plant) -> DataFrame:
    """Recommendations as four steps of the chain leave them, active and closed."""
    path = _chain_in_steps(p, _hours_of_facts())
    recs = analytics.chain_table(p.spark, path, "recommendations").unionByName(analytics.chain_table(p.spark, path, "closed"))
    return _shown(recs, ["asset_id", "rec_type", "status", "as_of_minute_ts", "created_at", "updated_at", "closed_by", "ack_until"])


@_query(" UNION ALL ".join(f"SELECT asset_id, CAST({n} AS BIGINT) AS step, {_ts('time_bucket(INTERVAL ' + str(n) + ' MINUTE, minute_ts)', 'minute_ts')}, max(risk_score) AS risk_score, max(risk_level) AS risk_level, max(failure_mode) AS failure_mode FROM drisk GROUP BY ALL" for n in chain.ROLLUP_STEPS))
def chain_rollups(p: Plant) -> DataFrame:
    """Risk by 5 and 15 minutes as the chain keeps it, late minutes included."""
    path = _chain_in_steps(p, [F.expr(f"not {_LATE}"), F.expr(_LATE)])
    return _shown(serving.rollup_series(analytics.chain_table(p.spark, path, "rollups"), None, *_range()), ["asset_id", "step", "minute_ts", "risk_score", "risk_level", "failure_mode"])


@_query(f"SELECT {_ANOMALY} FROM hyb h")
def chain_follow(p: Plant) -> DataFrame:
    """Anomalies of a consumer that goes by its mark: first early facts, then
    their corrections; a step that fails before its record is made again."""
    path = scratch_folder(p.spark)
    early = facts.minute_facts(p.good.filter("kafka_offset % 3 <> 0"))
    for i, minutes in enumerate((early, p.facts)):
        chain.publish_facts(p.spark, f"{path}/source", i, minutes)
        chain.follow(p.spark, f"{path}/source", path, MIN_EVENTS)
    chain.follow(p.spark, f"{path}/source", path, MIN_EVENTS)
    return _shown(analytics.chain_table(p.spark, path, "anomalies"), ANOMALY)


@_query(
    f"""SELECT f.asset_id, {_ts('f.minute_ts', 'minute_ts')}, CAST(coalesce(x.risk_score, 0) AS BIGINT) AS risk_score, CASE WHEN coalesce(x.risk_score, 0) <= {RiskOptions().low_max} THEN 'LOW' WHEN x.risk_score <= {RiskOptions().med_max} THEN 'MED' ELSE 'HIGH' END AS risk_level, x.failure_mode, coalesce(x.top_drivers, '') AS top_drivers
FROM fact f LEFT JOIN (SELECT asset_id, minute_ts, least(coalesce(CAST(round_even(sum(p) / 30.0, 0) AS DOUBLE), 0.0), 100.0) AS risk_score,
  {_MODE} AS failure_mode, array_to_string((list(anomaly_type || 'x' || k ORDER BY k DESC, first, anomaly_type))[:3], ', ') AS top_drivers
  FROM (SELECT f.asset_id, f.minute_ts, h.anomaly_type, sum({_POINTS} * (30 - date_diff('minute', h.minute_ts, f.minute_ts))) AS p, count(*) AS k, min(h.minute_ts) AS first FROM fact f JOIN hyb h ON h.asset_id = f.asset_id AND h.minute_ts <= f.minute_ts AND h.minute_ts > f.minute_ts - INTERVAL 30 MINUTE GROUP BY f.asset_id, f.minute_ts, h.anomaly_type) GROUP BY asset_id, minute_ts) x USING (asset_id, minute_ts)"""
)
def stream_window_risk(p: Plant) -> DataFrame:
    """Decay risk of every minute by sliding windows in a stream of anomalies."""
    path = scratch_folder(p.spark)
    for name, df in {"anomalies": p.hybrid.select(*ANOMALY), "minutes": p.facts.select("asset_id", "minute_ts")}.items():
        df.write.parquet(f"{path}/{name}")
    read = lambda name: p.spark.readStream.schema(p.spark.read.parquet(f"{path}/{name}").schema).parquet(f"{path}/{name}")
    windows.start_window_risk(read("anomalies"), f"{path}/risk", f"{path}/checkpoint", read("minutes"), trigger=_ONCE).awaitTermination()
    return _shown(windows.read_window_risk(p.spark, f"{path}/risk"), ["asset_id", "minute_ts", "risk_score", "risk_level", "failure_mode", "top_drivers"])


@_query(f"SELECT asset_id, {_ts()}, {_FACT} FROM fact")
def stream_fact_changes(p: Plant) -> DataFrame:
    """Early minutes in update mode: the newest row of each."""
    path = scratch_folder(p.spark)
    jobs.start_fact_changes(_event_stream(p), f"{path}/facts", f"{path}/checkpoint", trigger=_ONCE).awaitTermination()
    return _shown(sinks.read_newest(p.spark, f"{path}/facts", ["asset_id", "minute_ts"]).drop("fault_code_max"))


@_query("SELECT 'facts' AS table_name, count(*) AS n_rows FROM fact UNION ALL SELECT 'risk', count(*) FROM lrisk")
def tables_by_name(p: Plant) -> DataFrame:
    """Tables found in a folder by name."""
    path = scratch_folder(p.spark)
    p.facts.write.parquet(f"{path}/facts")
    p.limit_risk.write.parquet(f"{path}/risk")
    return serving.report_counts(telemetry.read_tables(p.spark, path, "facts", "risk"))


@_query(f"SELECT asset_id, {_ts()}, {_FACT} FROM fact")
def managed_facts(p: Plant) -> DataFrame:
    """Facts appended to a managed table in three batches, one of them twice."""
    path = scratch_folder(p.spark)
    base = "facts_" + path.rsplit("/", 1)[-1]
    sinks.create_database(p.spark, base, f"{path}/database")
    rows = p.facts.drop("fault_code_max").persist()
    try:
        for i in (0, 1, 1, 2):
            sinks.append_table(rows.filter(F.pmod(F.xxhash64("asset_id", "minute_ts"), F.lit(3)) == i), f"{base}.facts", batch=("facts", i))
    finally:
        rows.unpersist()
    return _shown(sinks.read_appended(p.spark, f"{base}.facts").select(*rows.columns))


@_query(
    f""", ok AS (SELECT asset_id, date_trunc('millisecond', ts) AS ts FROM tel WHERE {_KIND} IS NULL),
closed AS (SELECT * FROM (SELECT DISTINCT asset_id, date_trunc('minute', ts) AS minute_ts FROM ok) WHERE minute_ts + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM ok))
SELECT 'telemetry_raw' AS table_name, count(*) AS n_rows FROM ok UNION ALL SELECT unnest(['asset_minute_fact', 'enriched', 'threshold_risk', 'chain_features']), count(*) FROM closed
UNION ALL SELECT 'current', count(DISTINCT asset_id) FROM closed"""
)
def whole_plant(p: Plant) -> DataFrame:
    """Rows of the tables that all streams of the plant leave, from messages with
    broken ones among them; the second run lets the chain take in what the first closed."""
    path = scratch_folder(p.spark)
    _messages(p).select("value").write.text(f"{path}/in")
    for _ in range(2):
        raw = telemetry.read_message_files(p.spark, f"{path}/in")
        analytics.supervise(analytics.run_whole_plant(p.spark, raw, p.profiles, path, MIN_EVENTS, _ONCE))
    last = max(int(n.split("=")[1]) for n in sinks.folder_names(p.spark, f"{path}/analytics/current") if n.startswith("v="))
    tables = {
        "telemetry_raw": sinks.read_batches(p.spark, f"{path}/telemetry_raw"), "asset_minute_fact": p.spark.read.parquet(f"{path}/asset_minute_fact"), "enriched": sinks.read_batches(p.spark, f"{path}/analytics/enriched"),
        "threshold_risk": sinks.read_batches(p.spark, f"{path}/analytics/risk"), "chain_features": analytics.chain_table(p.spark, f"{path}/chain", "features"), "current": p.spark.read.parquet(f"{path}/analytics/current/v={last}"),
    }
    return serving.report_counts(tables)


_PARTS = 4


@_query(
    f"""SELECT CAST(b AS BIGINT) AS batch_id, count(*) AS n_events, count(*) FILTER (WHERE NOT is_late) AS n_accepted, count(*) FILTER (WHERE is_late) AS n_late
FROM (SELECT b, coalesce(date_trunc('minute', ts) + INTERVAL 1 MINUTE <= date_trunc('millisecond', newest) - INTERVAL 2 MINUTE, false) AS is_late
  FROM (SELECT *, kafka_offset % {_PARTS} AS b FROM good) g LEFT JOIN (SELECT c.b, max(o.ts) AS newest FROM (VALUES (0), (1), (2), (3)) AS c(b) JOIN good o ON o.kafka_offset % {_PARTS} <= c.b - 2 GROUP BY c.b) w USING (b)) GROUP BY b"""
)
def stream_late(p: Plant) -> DataFrame:
    """Events in four batches, each all over the day: how many came too late."""
    path = scratch_folder(p.spark)
    for i in range(_PARTS):
        p.good.filter(F.col("kafka_offset") % _PARTS == i).coalesce(1).write.mode("append").parquet(f"{path}/in")
    events = p.spark.readStream.schema(p.good.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query, listener = late.start_counted_facts(events, path, f"{path}/checkpoint", trigger=_ONCE)
    query.awaitTermination()
    late.await_arrivals(p.spark, query, listener)
    return _shown(late.late_counts(p.spark, path))


_STEPS = "CASE kafka_offset % 5 WHEN 1 THEN 't1|t2' WHEN 3 THEN 'x|y' ELSE '' END"


@_query(
    f"""SELECT asset_id, kafka_offset, CASE kafka_offset % 5 WHEN 0 THEN 'h' || asset_id WHEN 1 THEN 'AI Insight' WHEN 3 THEN 'AI Insight' ELSE 'Insight unavailable' END AS headline,
  CASE WHEN kafka_offset % 5 IN (0, 1, 3) THEN 'No summary returned.' ELSE 'The insight engine returned invalid JSON.' END AS summary, CASE kafka_offset % 5 WHEN 0 THEN 'a' ELSE '' END AS what_changed, '' AS likely_causes,
  {_STEPS} AS recommended_next_steps, CASE kafka_offset % 5 WHEN 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN kafka_offset % 5 IN (0, 1, 3) THEN '' ELSE 'llm_parse_error' END AS evidence_used,
  CASE WHEN kafka_offset % 5 IN (0, 1, 3) THEN 'Generated output may be imperfect; verify against source data.' ELSE 'Generated text may be imperfect; verify against underlying signals.' END AS disclaimer FROM good"""
)
def replies_normalised(p: Plant) -> DataFrame:
    """Replies built from the events' values, some broken, as typed rows."""
    n = F.col("kafka_offset") % 5
    text = (
        F.when(n == 0, F.concat(F.lit('Sure! {"headline": "h'), "asset_id", F.lit('", "confidence": 0.5, "what_changed": ["a", 1, " "]} bye')))
        .when(n == 1, F.lit('{"summary": 3, "recommendations": [{"Title": "t1"}, {"title": "t2"}, 7]}'))
        .when(n == 2, F.lit("no json"))
        .when(n == 3, F.lit('{"recommended_next_steps": ["x", "y"], "confidence": "high"}'))
    )
    df = normalise_replies(p.good.select("asset_id", "kafka_offset", text.alias("reply"))).drop("reply")
    return df.withColumns({f.name: F.array_join(f.name, "|") for f in df.schema.fields if f.dataType.typeName() == "array"})
