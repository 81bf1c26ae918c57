import datetime
import json
import os

from plantpulse.operators import detect, facts, features, risk
from plantpulse.sources import sinks, telemetry
from plantpulse.streaming import analytics, jobs

T0 = datetime.datetime(2024, 1, 1)


def line(seconds, value, asset="A", tag="temp_bearing_c", quality=192):
    ts = (T0 + datetime.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return json.dumps({"asset_id": asset, "asset_type": "Pump", "ts": ts, "tag": tag, "value": value, "quality": quality})


FILES = [
    [line(1, 1.0), line(30, 3.0), "broken", line(40, 9.0, quality=64)],
    [line(130, 5.0), line(50, 5.0)],  # the second is out of order, inside the watermark
    [line(200, 7.0), line(400, 1.0)],
    [line(410, 1.0)],  # a row counts as late by the watermark of the batch before
    [line(20, 100.0)],  # past the watermark: dropped
    [line(90_000, 0.0)],  # closes every earlier minute
]


def feed(path, files):
    path.mkdir(exist_ok=True)
    for i, lines in enumerate(files):
        f = path / f"{i:03}.txt"
        if not f.exists():
            f.write_text("\n".join(lines) + "\n")
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)  # files are read by age


def test_stream_equals_batch_and_restarts_add_nothing(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "out")
    once = {"availableNow": True}

    def run():
        raw = telemetry.read_message_files(spark, str(source), files_per_trigger=1)
        for q in jobs.run_plant(spark, raw, base, once):
            q.awaitTermination()
        read = spark.read.schema("asset_id string, minute_ts timestamp, avg_temp_c double, avg_vib_mm_s double, avg_pressure_bar double, avg_current_a double, avg_flow_m3h double, event_count int, fault_code_max int").parquet(f"{base}/asset_minute_fact")
        return sorted((r.minute_ts, r.avg_temp_c, r.event_count) for r in read.collect())

    feed(source, FILES)
    got = run()
    assert run() == got
    raw = spark.read.text(str(source)).selectExpr("value", "cast(null as bigint) AS offset", "cast(null as int) AS partition")
    batch = facts.minute_facts(telemetry.parse_events(raw).filter("value < 100 and ts < timestamp'2024-01-02 00:00:00'"))
    assert got == sorted((r.minute_ts, r.avg_temp_c, r.event_count) for r in batch.collect())
    assert spark.read.parquet(f"{base}/telemetry_raw").count() == 9


def test_update_mode_upserts_reach_the_same_facts(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "up")
    feed(source, FILES[:3])
    events = telemetry.parse_events(telemetry.read_message_files(spark, str(source), files_per_trigger=1))
    jobs.start_fact_upserts(events, base, f"{base}-checkpoint", trigger={"availableNow": True}).awaitTermination()
    last = max(int(d[2:]) for d in os.listdir(base))
    got = sorted((r.minute_ts, r.avg_temp_c, r.event_count) for r in spark.read.parquet(f"{base}/v={last}").collect())
    raw = spark.read.text(str(source)).selectExpr("value", "cast(null as bigint) AS offset", "cast(null as int) AS partition")
    assert got == sorted((r.minute_ts, r.avg_temp_c, r.event_count) for r in facts.minute_facts(telemetry.parse_events(raw)).collect())


def rows_of(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def test_changed_minutes_reach_the_same_facts(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "changes")
    feed(source, FILES[:3])
    events = telemetry.parse_events(telemetry.read_message_files(spark, str(source), files_per_trigger=1))
    jobs.start_fact_changes(events, path, f"{path}-checkpoint", trigger={"availableNow": True}).awaitTermination()
    raw = spark.read.text(str(source)).selectExpr("value", "cast(null as bigint) AS offset", "cast(null as int) AS partition")
    want = facts.minute_facts(telemetry.parse_events(raw))
    got = sinks.read_newest(spark, path, ["asset_id", "minute_ts"])
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    assert spark.read.parquet(path).count() > want.count()  # a minute changed twice


def test_analytics_fan_out_and_chain_equal_the_batch_tables(spark, tmp_path):
    source, base = tmp_path / "in", str(tmp_path / "out")
    tags = ("temp_bearing_c", "vib_rms_mm_s", "motor_current_a", "flow_rate_m3_h", "discharge_pressure_bar")
    level = lambda m: 60 + m + 30 * (m > 60)
    minutes = [[line(60 * m + 5, level(m) + i, asset, tag) for asset in ("PUMP_001", "EXTRA_001") for i, tag in enumerate(tags)] for m in range(90)]
    feed(source, [sum(minutes[i : i + 30], []) for i in range(0, 90, 30)] + [[line(90_000, 0.0)], [line(180_000, 0.0)]])
    profiles = telemetry.load_asset_profiles(spark)
    once = {"availableNow": True}

    def run():
        events = telemetry.parse_events(telemetry.read_message_files(spark, str(source), files_per_trigger=1))
        analytics.start_analytics(events, profiles, base, f"{base}/checkpoints/analytics", trigger=once).awaitTermination()
        analytics.start_chain(spark, f"{base}/facts", f"{base}/chain", f"{base}/checkpoints/chain", 1, once).awaitTermination()
        tables = {t: sinks.read_batches(spark, f"{base}/{t}").drop("batch_id") for t in ("facts", "enriched", "features", "anomalies", "risk")}
        return {t: rows_of(df) for t, df in tables.items()} | {f"chain {t}": rows_of(analytics.chain_table(spark, f"{base}/chain", t)) for t in analytics.KEYS}

    got = run()
    minute = facts.minute_facts(telemetry.parse_events(spark.read.text(str(source)).selectExpr("value", "0L AS offset", "0 AS partition")).filter("ts < timestamp'2024-01-03'"))
    enriched = facts.enrich(minute, profiles)
    rolling = features.features_rolling(minute.select(*analytics.FACT), 1)
    hybrid = detect.hybrid_anomalies(rolling)
    want = {"facts": minute.select(*analytics.FACT), "enriched": enriched, "features": features.features_minimal(minute), "anomalies": detect.threshold_anomalies(minute), "risk": risk.threshold_risk(enriched)}
    assert all(rows_of(df) == got[t] for t, df in want.items())
    assert hybrid.count() > 0 and len(got["chain risk"]) == risk.decay_risk(hybrid).count()
    keyed = lambda df: sorted((r.asset_id, r.minute_ts, r.anomaly_type, r.severity) for r in df.collect())
    assert keyed(analytics.chain_table(spark, f"{base}/chain", "anomalies")) == keyed(hybrid)
    assert sinks.load_mark(spark, f"{base}/chain/marks", "chain") == minute.agg({"minute_ts": "max"}).first()[0]
    assert sinks.load_mark(spark, f"{base}/chain/marks", "nobody", T0) == T0
    last = max(int(d[2:]) for d in os.listdir(f"{base}/current") if d.startswith("v="))
    state = spark.read.parquet(f"{base}/current/v={last}")
    assert rows_of(state.select("asset_id", "as_of_minute_ts")) == rows_of(risk.current_risk(want["risk"]).select("asset_id", "as_of_minute_ts"))
    recs = max(int(d[2:]) for d in os.listdir(f"{base}/chain/recommendations") if d.startswith("v="))
    assert spark.read.parquet(f"{base}/chain/recommendations/v={recs}").filter("status = 'OPEN'").groupBy("asset_id", "rec_type").count().filter("count > 1").count() == 0
    # a batch that is run again, and a restart, change nothing
    again = spark.read.parquet(f"{base}/risk/batch_id=1")
    sinks.append_batch(spark.createDataFrame(again.collect(), again.schema), f"{base}/risk", 1)
    assert run() == got
