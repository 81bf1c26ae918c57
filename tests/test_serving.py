import datetime

import pytest

from plantpulse.plans import serving

T = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def current(spark):
    rows = [(f"{kind}_{i:03d}", T, float(10 * i), "LOW", None, None) for kind in ("FAN", "PUMP") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "asset_id string, as_of_minute_ts timestamp, risk_score double, risk_level string, failure_mode string, top_drivers string")


def test_asset_pages(current):
    page = serving.list_assets(current, "_00", 2).collect()
    assert [r.asset_id for r in page] == ["FAN_001", "FAN_002"]
    rest = serving.list_assets(current, "P", 9, serving.next_cursor(page, 2)).collect()
    assert [r.asset_id for r in rest] == ["PUMP_001", "PUMP_002", "PUMP_003"]
    assert serving.next_cursor(rest, 9) is None
    assert serving.list_assets(current, "%").count() == 0 and serving.list_assets(current).count() == 6


def test_panels_serve_some_or_all_assets(current):
    assert [r.metric for r in serving.panel_score_by_asset(current, ["PUMP_002", "none"]).collect()] == ["PUMP_002"]
    assert serving.panel_score_by_asset(current).count() == 6 and serving.panel_levels(current, []).count() == 0
    day = datetime.timedelta(days=1)
    series = lambda assets, lo, hi: serving.panel_series(current, "risk_score", assets, lo, hi, "as_of_minute_ts").count()
    assert (series(None, T, T + day), series(["FAN_001"], T, T + day), series(None, T - day, T)) == (6, 1, 0)


def test_queues_are_ordered_and_limited(spark):
    rows = [(i, f"A{i % 2}", "INSPECT", "OPEN" if i % 3 else "ACKED", T, T + datetime.timedelta(minutes=i // 2)) for i in range(12)]
    recs = spark.createDataFrame(rows, "recommendation_id long, asset_id string, rec_type string, status string, created_at timestamp, as_of_minute_ts timestamp")
    ids = lambda df: [r.recommendation_id for r in df.collect()]
    assert ids(serving.rec_queue(recs, "OPEN", 3)) == [10, 11, 8]
    assert ids(serving.rec_queue(recs, "active", None, "A1")) == [11, 9, 7, 5, 3, 1]
    assert ids(serving.asset_recs(recs, "A0", "acked")) == [6, 0]
    assert ids(serving.asset_recs(recs, None, None, 2)) == [10, 11]
