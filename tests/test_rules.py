import datetime
import random

import twins

from plantpulse.config import CODE_HYBRID, DEPLOYED_HYBRID
from plantpulse.operators import detect, facts, features, risk
from plantpulse.sources import telemetry

T0 = datetime.datetime(2024, 1, 1)
FACT = "asset_id string, minute_ts timestamp, avg_temp_c double, avg_vib_mm_s double, avg_current_a double, avg_flow_m3h double, avg_pressure_bar double, event_count int, fault_code_max int"
COLUMNS = ["avg_temp_c", "avg_vib_mm_s", "avg_current_a", "avg_flow_m3h", "avg_pressure_bar"]


def minute(m):
    return T0 + datetime.timedelta(minutes=m)


def number(ts):
    return int((ts - T0).total_seconds() // 60)


def test_limits_and_risk_at_every_boundary(spark):
    edges = {"avg_temp_c": (75, 75.0001, 88, 88.0001, None), "avg_vib_mm_s": (4, 4.01, 7, 7.01, None), "avg_current_a": (25, 25.01, 30, 30.01, None), "avg_flow_m3h": (85, 84.9, 70, 69.9, None), "avg_pressure_bar": (6.5, 6.49, 5.5, 5.49, None)}
    rng, rows = random.Random(1), []
    for i in range(300):
        asset = rng.choice(["COMP_001", "FAN_001", "PUMP_002", "NEW"])
        rows.append((asset, minute(i), *[None if (v := rng.choice(edges[c])) is None else float(v) for c in COLUMNS], 5, None))
    df = spark.createDataFrame(rows, FACT)
    found = {}
    for r in detect.threshold_anomalies(df).collect():
        found.setdefault((r.asset_id, r.minute_ts), []).append((r.anomaly_type, r.severity))
    weights = {"COMP_001": 1.25, "FAN_001": 1.0, "PUMP_002": 0.8, "NEW": 1.0}
    scored = {(r.asset_id, r.minute_ts): (r.risk_score, r.risk_level, r.failure_mode, r.top_drivers) for r in risk.threshold_risk(facts.enrich(df, telemetry.load_asset_profiles(spark))).collect()}
    for row in rows:
        fact = dict(zip(["asset_id", "minute_ts", *COLUMNS], row))
        assert sorted(found.get(row[:2], [])) == sorted(twins.limits(fact))
        assert scored[row[:2]] == twins.limit_risk(fact, weights[row[0]])


def test_half_even_rounding(spark):
    one_warning = spark.createDataFrame([("COMP_001", T0, 80.0, None, None, None, None, 5, None)], FACT)
    assert risk.threshold_risk(facts.enrich(one_warning, telemetry.load_asset_profiles(spark))).first().risk_score == 12.0


def _series(rng, n):
    rows = []
    for asset in ("A", "B"):
        level = 0.0
        for m in range(1380, 1380 + n):  # across midnight: chunks with a carried lookback
            if rng.random() < 0.1:
                continue
            level += rng.uniform(-0.5, 0.8)
            pick = lambda x: None if rng.random() < 0.05 else x
            rows.append((asset, minute(m), pick(60 + 3 * level), pick(3 + level), pick(20 + level), pick(100 + rng.uniform(-30, 30)), 8.0, rng.choice([1, 5, 9]), None))
    return rows


def test_hybrid_detector_and_decay_risk_equal_their_twins(spark):
    df = spark.createDataFrame(_series(random.Random(4), 240), FACT)
    rolling = features.features_rolling(df, 2).cache()
    rows = [r.asDict() | {"m": number(r.minute_ts)} for r in rolling.collect()]
    for options in (DEPLOYED_HYBRID, CODE_HYBRID):
        found = detect.hybrid_anomalies(rolling, options).cache()
        got = sorted((r.asset_id, number(r.minute_ts), r.anomaly_type, round(r.score, 6), r.severity) for r in found.collect())
        want = sorted((a, m, kind, round(s, 6), severity) for a in "AB" for m, kind, s, severity in twins.hybrid([r for r in rows if r["asset_id"] == a and r["quality_gate_ok"]], options))
        assert got == want and got
        scored = {(r.asset_id, number(r.minute_ts)): (r.risk_score, r.risk_level, r.failure_mode, r.top_drivers) for r in risk.decay_risk(found).collect()}
        for a, m in {(x[0], x[1]) for x in got}:
            assert scored[a, m] == twins.decay([(x[1], x[2], x[4]) for x in got if x[0] == a], m)
        assert len(scored) == len({x[:2] for x in got})


def test_chunked_windows_equal_whole_history(spark, monkeypatch):
    from plantpulse.operators import chunks

    df = spark.createDataFrame(_series(random.Random(9), 200), FACT)
    daily = sorted(features.features_rolling(df).collect())
    whole = chunks.in_chunks
    monkeypatch.setattr(features, "in_chunks", lambda d, e, b: whole(d, e, b, 10_000_000))
    assert sorted(features.features_rolling(df).collect()) == daily


def test_decay_edges(spark):
    schema = "asset_id string, minute_ts timestamp, anomaly_type string, signal string, score double, severity int"
    rows = [("A", minute(0), "VIB_SPIKE", "v", 1.0, 3), ("A", minute(29), "X", "x", 1.0, 2), ("A", minute(30), "FLOW_DROP", "f", 1.0, 2), ("A", minute(30), "VIB_DRIFT", "v", 1.0, 2)]
    rows += [("B", minute(5), "VIB_SPIKE", "v", 1.0, 3)] * 60
    got = {(r.asset_id, number(r.minute_ts)): r for r in risk.decay_risk(spark.createDataFrame(rows, schema)).collect()}
    assert (got["A", 0].risk_score, got["A", 29].risk_score, got["A", 30].risk_score) == (30, 6, 32)
    assert got["A", 30].failure_mode == "CAVITATION" and got["A", 30].top_drivers == "Xx1, FLOW_DROPx1, VIB_DRIFTx1"
    assert got["B", 5].risk_score == 100 and got["B", 5].evidence_json.count("anomalyType") == 50
    dense = risk.decay_risk(spark.createDataFrame(rows[:1], schema), minutes=spark.createDataFrame([("A", minute(m)) for m in (0, 10, 40)], "asset_id string, minute_ts timestamp"))
    assert {number(r.minute_ts): r.risk_score for r in dense.collect()} == {0: 30, 10: 20, 40: 0}
