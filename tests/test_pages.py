import datetime
import random

import pytest

from plantpulse.config import RiskOptions
from plantpulse.operators import detect, features, risk
from plantpulse.plans import pages
from plantpulse.streaming import windows
from test_chain import noisy, rows_of, scanned, table_of

T0 = datetime.datetime(2024, 1, 1)
ORDER = ("-t", "k")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(T0 + datetime.timedelta(minutes=rng.randrange(400)), f"k{i:04}", i) for i in range(5000)]
    path = tmp_path_factory.mktemp("pages").as_uri()
    pages.write_pages(spark.createDataFrame(rows, "t timestamp, k string, v int").repartition(5), path, ORDER, 250)
    return path, sorted(rows, key=lambda r: (-r[0].timestamp(), r[1]))


def test_pages_in_a_row_are_the_sorted_table(spark, stored):
    path, want = stored
    key, got = None, []
    while page := pages.read_page(spark, path, ORDER, 900, key).collect():
        got += map(tuple, page)
        key = (page[-1].t, page[-1].k)
    assert got == want


def test_a_page_opens_few_files(spark, stored):
    path, want = stored
    assert spark.read.parquet(f"{path}/index").count() > 10
    for key, take in ((None, 5), ((want[2600][0], want[2600][1]), 60)):
        read = pages.read_page(spark, path, ORDER, take, key)
        assert scanned(read) < 1000 and len(pages.pages_of(spark, path, ORDER, take, key)) <= 3
        start = 0 if key is None else 2601
        assert [tuple(r) for r in read.collect()] == want[start : start + take]
    plan = read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [page" in plan.replace("isnotnull(page", "page")
    assert pages.read_page(spark, path, ORDER, 5, (T0 - datetime.timedelta(days=1), "")).count() == 0


def test_windows_in_the_stream_equal_dense_decay(spark, tmp_path):
    """Anomalies and minutes in several files, a minute out of order, one type unknown."""
    minute = table_of(spark, noisy(["A", "B"], range(50)))
    found = detect.hybrid_anomalies(features.features_rolling(minute, 1)).select("asset_id", "minute_ts", "anomaly_type", "signal", "severity")
    odd = spark.createDataFrame([("A", T0 + datetime.timedelta(minutes=33), "ODD", "x", 3)], found.schema)
    found = found.unionByName(odd).persist()
    for part in ("minute_ts < timestamp'2024-01-01 00:25:00'", "minute_ts >= timestamp'2024-01-01 00:25:00'"):
        found.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        minute.select("asset_id", "minute_ts").filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    read = lambda n: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
    out = f"{tmp_path}/risk"
    windows.start_window_risk(read("a"), out, f"{tmp_path}/c", read("m"), watermark="10 minutes", trigger={"availableNow": True}).awaitTermination()
    columns = ["asset_id", "minute_ts", "risk_score", "risk_level"]
    want = risk.decay_risk(found, RiskOptions(), minute)
    assert rows_of(windows.read_window_risk(spark, out).select(*columns)) == rows_of(want.select(*columns))
    # as a table, where anomalies are; mode and drivers of known types
    known = found.filter("anomaly_type <> 'ODD'")
    got = windows.window_risk(known)
    assert rows_of(got) == rows_of(risk.decay_risk(known).select(*got.columns))
