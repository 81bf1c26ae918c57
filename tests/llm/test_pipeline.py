import brute

import corpus_pipeline
from plantpulse.llm import quality_rules


def test_stages_take_effect_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).collect() if r.kept}
    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    one = first(spark, docs, sf).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    near = brute.near([(r.doc_id, r.text) for r in one.collect()])
    two = second(spark, one, sf).cache()
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {d for d, v in near.items() if v[2]}
    windows = brute.word_windows([(r.doc_id, r.text) for r in two.collect()])
    three = third(spark, two, sf).cache()
    assert three.columns == docs.columns
    assert {r.doc_id: len(brute.WORD.findall(r.text)) for r in three.collect()} == {d: n - gone for d, (n, gone, _) in windows.items()}
    four = last(spark, three, sf)
    assert {r.doc_id for r in four.collect()} == set(windows)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_of_odd_rows(spark, odd, sf):
    """Columns named like the stages' own, nulls, repeated rows and ids."""
    names = "text_key host key lines depleted gone_id gone_key removed_id removed_key runs line dealt row_key"
    docs = odd.selectExpr("*", *[f"'{n}' AS {n}" for n in names.split()]).filter("text is null or length(text) > 0")
    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    one = first(spark, docs, sf)
    assert one.columns == docs.columns and sorted((r.doc_id or 0, r.host) for r in one.collect()) == [(0, "host"), (1, "host"), (1, "host"), (2, "host")]
    two = second(spark, docs, sf)
    assert two.columns == docs.columns
    # equal rows stay together; of the texts of id 2 one has gone
    assert sorted((r.doc_id or 0, r.text is None or len(r.text)) for r in two.collect()) == [(0, True), (0, 229), (1, 229), (1, 229), (2, 10), (3, True)]
    three = third(spark, docs, sf)
    assert three.columns == docs.columns and three.count() == 7
    assert sorted((r.doc_id, len(r.text)) for r in three.collect() if r.doc_id and r.text is not None) == [(1, 229), (1, 229), (2, 0), (2, 10)]
    assert sorted((r.doc_id or 0, r.piece) for r in last(spark, docs, sf).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0), (3, 0)]
    empty = docs.limit(0)
    for stage in (first, second, third, last):
        assert stage(spark, empty, sf).count() == 0


def _python_steps(node) -> tuple[int, int]:
    """Most Python steps that a task of the plan below runs at once: in the task of this node, and in any."""
    under = [node.children().apply(i) for i in range(node.children().size())]
    here = max([0] + [_python_steps(x)[0] for x in under]) + ("MapInArrow" in node.nodeName())
    return 0 if "Exchange" in node.nodeName() else here, max([here] + [_python_steps(x)[1] for x in under])


def test_quality_tasks_hold_one_python_worker(spark, sf):
    """Each worker is memory of an executor that stays taken; also where a join is small and gets no exchange."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _python_steps(out._jdf.queryExecution().executedPlan()) == (1, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
