import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from plantpulse import session
from plantpulse.operators import detect, facts, features, risk
from plantpulse.plans import serving
from plantpulse.sources import commits, sinks
from plantpulse.streaming import chain, jobs

T0 = datetime.datetime(2024, 1, 1)
FACT = "asset_id string, minute_ts timestamp, avg_temp_c double, avg_vib_mm_s double, avg_pressure_bar double, avg_current_a double, avg_flow_m3h double, event_count int, fault_code_max int"


def at(minute):
    return T0 + datetime.timedelta(minutes=minute)


def fact(asset, minute, level):
    return (asset, at(minute), 60.0 + level, 2.0 + level / 10, 8.0, 20.0 + level / 5, 100.0 - level, 9, None)


def noisy(assets, minutes, seed=1):
    rng = random.Random(seed)
    return [fact(a, m, rng.random() * 30 + (25 if m % 40 > 30 else 0)) for a in assets for m in minutes]


def table_of(spark, rows):
    return spark.createDataFrame(rows, FACT)


def batch_tables(df):
    rolling = features.features_rolling(df, 1)
    found = detect.hybrid_anomalies(rolling)
    scored = risk.decay_risk(found)
    return {"features": rolling, "anomalies": found, "risk": scored, "current": risk.current_risk(scored)}


def rows_of(df):
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.collect())


def step(spark, base, number, df, part):
    """One step of the chain by hand over all facts so far."""
    days = lambda _: df.withColumn("event_date", F.to_date("minute_ts"))
    chain.step(commits.Batch(spark, base, "chain", number), days, part, 1)


def tables(spark, base):
    return {n: rows_of(chain.chain_table(spark, base, n).select(*batch_columns[n])) for n in batch_columns}


batch_columns = {"features": features.COLUMNS, "anomalies": ["asset_id", "minute_ts", "anomaly_type", "severity", "score"], "risk": chain.CURRENT[:1] + ["minute_ts"] + chain.CURRENT[2:6], "current": chain.CURRENT[:6]}


def wanted(df):
    return {n: rows_of(t.select(*batch_columns[n])) for n, t in batch_tables(df).items()}


def test_late_minutes_take_stale_rows_back(spark, tmp_path):
    """Fifty-five minutes, then five earlier ones: nothing stays that the whole
    table doesn't have, and states and rollups follow."""
    base = tmp_path.as_uri()
    rows = noisy(["A"], range(60))
    late = [r for r in rows if 20 <= (r[1] - T0).seconds // 60 < 25]
    first, all_ = table_of(spark, [r for r in rows if r not in late]), table_of(spark, rows)
    step(spark, base, 0, first, first)
    before = tables(spark, base)
    assert before == wanted(first)
    step(spark, base, 1, all_, table_of(spark, late))
    after = tables(spark, base)
    assert after == wanted(all_)
    assert set(before["anomalies"]) - set(after["anomalies"])  # some were taken back
    scored = batch_tables(all_)["risk"]
    for n in chain.ROLLUP_STEPS:
        got = serving.rollup_series(chain.chain_table(spark, base, "rollups"), "A", at(0), at(999), n).drop("step")
        want = serving.risk_series(scored, "A", at(0), at(999), n)
        assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_a_day_of_many_versions_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MERGE", 3)
    base = tmp_path.as_uri()
    rows = lambda *r: spark.createDataFrame([(k, at(m), v) for k, m, v in r], "k string, minute_ts timestamp, v int")
    keys = ["k", "minute_ts"]
    for i, (made, redo) in enumerate([([("a", 1, 0), ("a", 1500, 0)], [("a", 1), ("a", 2), ("a", 1500)]), ([("a", 2, 1)], [("a", 1), ("a", 2)]), ([("b", 1, 2), ("b", 1, 3)], [("b", 1)]), ([], [("a", 2)])]):
        b = commits.Batch(spark, base, "t", i)
        b.change("t", rows(*made), rows(*[(k, m, 0) for k, m in redo]).drop("v"), keys)
        b.publish()
        if i == 2:
            held = commits.folders(spark, base, "t", "t")
            assert {d: len(x) for d, x in held.items()} == {"2024-01-01": 1, "2024-01-02": 1}
    got = commits.settled(commits.read(spark, base, "t", "t"), keys)
    assert sorted((r.k, r.minute_ts, r.v) for r in got.collect()) == [("a", at(1500), 0), ("b", at(1), 2), ("b", at(1), 3)]
    assert commits.Batch(spark, base, "t", -1).parts_since("t", 3) == ["2024-01-01"]


def test_an_asset_whose_newest_risk_goes_falls_back(spark, tmp_path):
    base = tmp_path.as_uri()
    calm = [fact("A", m, 5.0) for m in range(70)]
    spike = [*calm[:40], fact("A", 40, 29.0), *calm[41:]]
    two = [*spike[:65], *[fact("A", m, 5.0) for m in range(300, 340)], fact("A", 340, 29.0)]
    step(spark, base, 0, table_of(spark, two), table_of(spark, two))
    fixed = [*two[:-1], fact("A", 340, 5.0)]
    step(spark, base, 1, table_of(spark, fixed), table_of(spark, [fixed[-1]]))
    assert tables(spark, base) == wanted(table_of(spark, fixed)) and tables(spark, base)["current"]


def test_a_crash_before_the_record_leaves_nothing_and_a_replay_changes_nothing(spark, tmp_path, monkeypatch):
    base, source = (tmp_path / "out").as_uri(), (tmp_path / "src").as_uri()
    rows = noisy(["A"], range(60))
    chain.publish_facts(spark, source, 0, table_of(spark, rows[:30]))
    assert chain.follow(spark, source, base, 1) == 1
    before = tables(spark, base)

    def crash(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        chain.publish_facts(spark, source, 1, table_of(spark, rows[30:]), crash)
    assert chain.follow(spark, source, base, 1) == 0  # facts without a record don't count
    chain.publish_facts(spark, source, 1, table_of(spark, rows[30:]))
    publish = commits.Batch.publish
    monkeypatch.setattr(commits.Batch, "publish", crash)
    with pytest.raises(RuntimeError):
        chain.follow(spark, source, base, 1)
    monkeypatch.setattr(commits.Batch, "publish", publish)
    assert tables(spark, base) == before and sinks.load_mark(spark, f"{base}/marks", "chain") == at(29)
    assert chain.follow(spark, source, base, 1) == 1
    assert tables(spark, base) == wanted(table_of(spark, rows)) and sinks.load_mark(spark, f"{base}/marks", "chain") == at(59)
    # the same batches again
    chain.publish_facts(spark, source, 1, table_of(spark, rows[:5]))
    assert chain.follow(spark, source, base, 1) == 0
    step(spark, base, 2, table_of(spark, rows[:5]), table_of(spark, rows[:5]))
    assert tables(spark, base) == wanted(table_of(spark, rows))


def scanned(df):
    """Rows that the scans of a plan read."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        n = nodes.pop()
        kind = n.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(n.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(n.plan())
        if kind == "FileSourceScanExec":
            total += n.metrics().apply("numOutputRows").value()
        children = n.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_reads_reach_the_scan_and_dont_grow_with_history(spark, tmp_path):
    path, changed = str(tmp_path / "facts"), table_of(spark, [fact("A", 1440 * 6 + 700, 9.0)])
    counts = []
    for first in (5, 3, 0):  # ever longer histories up to the same day
        rows = table_of(spark, [fact(a, m, 9.0) for a in "AB" for m in range(1440 * first, 1440 * (first + 2 if first else 3) + (1440 * 1 if first == 5 else 0), 20)])
        rows.withColumn("event_date", F.to_date("minute_ts")).write.mode("append").partitionBy("event_date").parquet(path)
        spans, days, time = chain.reach(changed)
        read = chain.near(chain.fact_files(spark, path, spark.read.parquet(path).schema)(days), spans, time)
        counts.append(scanned(read))
    assert counts[0] == counts[1] == counts[2] > 0
    plan = read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(minute_ts" in plan
    assert read.filter("asset_id = 'A'").count() == read.count() > 0


def tasks_of(spark, group, run):
    """Tasks of the jobs that ``run`` starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_a_steps_tasks_follow_its_rows_not_the_shuffle_partitions(spark, tmp_path):
    rows, set_ = table_of(spark, noisy("AB", range(60))), spark.conf.get("spark.sql.shuffle.partitions")
    sized = spark.conf.get(session._SIZED)
    counts = {}
    try:
        for n in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            base = (tmp_path / str(n)).as_uri()
            counts[n] = tasks_of(spark, f"step over {n}", lambda: step(spark, base, 0, rows, rows))  # noqa: B023
            assert tables(spark, base) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_)
    assert 0 < counts[40] < 1.5 * counts[4]
    assert spark.conf.get(session._SIZED) == sized  # the caller's session is left as it was


def test_states_write_the_buckets_of_changed_keys(spark, tmp_path):
    base = tmp_path.as_uri()
    keyed = lambda rows: spark.createDataFrame(rows, "k string, v int")
    one = commits.Batch(spark, base, "t", 0)
    all_ = keyed([(f"k{i}", 0) for i in range(2000)])
    one.put("t", all_, all_, ["k"], 16)
    one.publish()
    size = lambda v: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "t" / f"v={v}") for f in fs if f.endswith(".parquet"))
    two = commits.Batch(spark, base, "t", 1)
    two.put("t", keyed([("k5", 1)]), keyed([("k5", 0), ("k7", 0)]), ["k"], 16)
    assert commits.read(spark, base, "t", "t").count() == 2000  # not yet
    two.publish()
    got = {r.k: r.v for r in commits.read(spark, base, "t", "t").collect()}
    assert len(got) == 1999 and got["k5"] == 1 and "k7" not in got and size(2) < size(1) / 4
    again = commits.Batch(spark, base, "t", 1)
    assert again.done and commits.Batch(spark, base, "other", 0).version == 1
    for i in (2, 3, 4):
        b = commits.Batch(spark, base, "t", i)
        b.put("t", keyed([("k9", i)]), keyed([("k9", 0)]), ["k"], 16)
        b.publish()
    held = {p for x in commits.folders(spark, base, "t", "t").values() for p in x}
    disk = {f"{d}/{n}" for d in os.listdir(tmp_path / "t") for n in os.listdir(tmp_path / "t" / d) if n.startswith("bucket")}
    assert held <= disk and len(disk - held) <= commits.KEEP + 1  # what was replaced long ago is gone


def test_published_facts_follow_a_stream(spark, tmp_path):
    from plantpulse.sources import telemetry
    from test_streams import FILES, feed

    feed(tmp_path / "in", FILES[:3])
    base, out = (tmp_path / "src").as_uri(), (tmp_path / "out").as_uri()
    events = telemetry.parse_events(telemetry.read_message_files(spark, str(tmp_path / "in"), files_per_trigger=1))
    chain.start_published_facts(events, base, f"{base}/checkpoint", trigger={"availableNow": True}).awaitTermination()
    raw = spark.read.text(str(tmp_path / "in")).selectExpr("value", "0L AS offset", "0 AS partition")
    want = facts.minute_facts(telemetry.parse_events(raw))
    assert rows_of(commits.settled(commits.read(spark, base, "facts", "facts"), chain.MINUTE).select(*want.columns)) == rows_of(want)
    assert chain.follow(spark, base, out, 1) > 0


def test_a_repeated_managed_append_replaces_its_rows(spark):
    sinks.create_database(spark, "ledger_of_tests")
    try:
        name = "ledger_of_tests.minutes"
        df = lambda *minutes: spark.createDataFrame([("A", at(m)) for m in minutes], "asset_id string, minute_ts timestamp")
        sinks.append_table(df(1, 2, 1500), name, batch=("facts", 0))
        sinks.append_table(df(3), name, batch=("facts", 1))
        sinks.append_table(df(3), name, batch=("other", 0))
        sinks.append_table(df(1, 2), name, batch=("facts", 0))  # once more, on fewer days
        got = sinks.read_appended(spark, name)
        assert sorted((r.stream, r.batch_id, r.minute_ts) for r in got.collect()) == [("facts", 0, at(1)), ("facts", 0, at(2)), ("facts", 1, at(3)), ("other", 0, at(3))]
        assert spark.table(f"{name}_ledger").count() == 3
        # rows without an entry in the ledger are not seen
        spark.table(name).limit(1).withColumn("batch_id", F.lit(9).cast("long")).select(*spark.table(name).columns).write.insertInto(name)
        assert sinks.read_appended(spark, name).count() == 4 and spark.table(name).count() == 5
    finally:
        spark.sql("DROP DATABASE ledger_of_tests CASCADE")


def test_reach_spans_are_by_day(spark):
    changed = spark.createDataFrame([("A", at(10)), ("A", at(5000)), ("B", at(5000))], "asset_id string, minute_ts timestamp")
    spans, days, time = chain.reach(changed)
    assert spans.count() == 3 and days == [datetime.date(2023, 12, 31), datetime.date(2024, 1, 1), datetime.date(2024, 1, 4)]
    assert chain.reach(changed.limit(0)) is None and time[0] == at(10 - jobs.REACH_MINUTES)


def test_the_whole_plant_runs_and_a_failing_stream_stops_the_others(spark, tmp_path):
    from plantpulse.sources import telemetry
    from plantpulse.streaming import analytics
    from test_streams import feed, line

    feed(tmp_path / "in", [[line(60 * m + s, 60.0 + m % 7, "PUMP_001") for m in range(30) for s in (1, 9)], [line(90_000, 0.0)], [line(180_000, 0.0)]])
    base, once = str(tmp_path / "out"), {"availableNow": True}
    for _ in range(2):  # the chain finds in the second run what the first one closed
        raw = telemetry.read_message_files(spark, str(tmp_path / "in"), files_per_trigger=1)
        analytics.supervise(analytics.run_whole_plant(spark, raw, telemetry.load_asset_profiles(spark), base, 1, once), 0.5)
    assert chain.chain_table(spark, f"{base}/chain", "features").count() == 31 == spark.read.parquet(f"{base}/asset_minute_fact").count()
    assert sinks.read_batches(spark, f"{base}/analytics/enriched").count() == 31

    def fail(batch, batch_id):
        raise RuntimeError("broken")

    rate = spark.readStream.format("rate").load()
    good = rate.writeStream.format("noop").start()
    bad = rate.writeStream.foreachBatch(fail).option("checkpointLocation", f"{base}/bad").start()
    with pytest.raises(Exception, match="broken"):
        analytics.supervise([good, bad], 0.2)
    assert not good.isActive and not bad.isActive
