"""What a task holds or a shuffle moves, read from plans and files over small tables of these tests' own."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lorescope.operators import graph as B
from lorescope.operators import reshape as R
from lorescope.operators import votes as V
from lorescope.plans import agreement_queries, mining_queries, stream_queries
from lorescope.plans.registry import Inputs
from lorescope.session import shuffle_width
from lorescope.streaming import streams as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below_exchanges(df) -> str:
    """The steps before the first shuffle of each branch: those of the tasks that read."""
    lines, reading = plan(df).split("\n"), []
    for line in reversed(lines):
        if "Exchange" in line:
            break
        reading.append(line)
    return "\n".join(reading)


def test_entities_of_one_class_are_not_made_distinct_by_one_task(spark):
    links = spark.createDataFrame([("customer", "party")], "sub string, sup string")
    classes = B.descendants(links, ["party", "order"])
    assert sorted(map(tuple, classes.collect())) == [("customer", "party"), ("order", "order"), ("party", "party")]
    entities = spark.createDataFrame([("o1", "order"), ("o1", "order"), ("c1", "customer"), ("x", "other")], "subj string, class string")
    typed = B.instances(entities, classes)
    assert sorted(map(tuple, typed.collect())) == [("c1", "party"), ("o1", "order")]
    assert "SortMergeJoin" not in plan(typed)  # the size of the closure is known
    assert "Aggregate" not in below_exchanges(typed)


def test_claims_are_sorted_once_and_labels_are_merged(spark):
    claims = spark.createDataFrame([("a", "p", "b", 1), ("a", "q", "b", 1), ("a", "q", "c", 1)], "subj string, prop string, obj string, prop_rank int")
    single = B.single_valued(claims)
    assert [tuple(r) for r in single.collect()] == [("a", "p", "b", 1)]
    assert "Aggregate" not in below_exchanges(single)
    labels = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string")
    names = spark.createDataFrame([("p", "P")], "prop string, prop_label string")
    labelled = B.with_labels(single, labels, names)
    assert [tuple(r) for r in labelled.select("subj_label", "prop_label", "obj_label").collect()] == [("A", "P", "B")]
    assert plan(labelled).count("SortMergeJoin") >= 2


def test_newest_rows_are_dealt_before_they_are_sorted(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, _batch bigint")
    newest = T._newest(rows, ["k"])
    assert sorted(map(tuple, newest.select("k", "v").collect())) == [("a", 2), ("b", 3)]
    assert "Sort" not in below_exchanges(newest)


def test_votes_are_sorted_apart_from_their_join(spark):
    width = shuffle_width(spark)
    votes = spark.range(100).selectExpr("id % 7 AS probe_id", "'a' AS answer", "'Yes.' AS verdict_text")
    truth = spark.range(7).selectExpr("id AS probe_id", "'a' AS gt_answer")
    judged = V.evaluate_judged(votes.repartition(width, "probe_id"), truth)
    assert judged.agg(F.sum("n_votes"), F.count_if("knowledgable")).first()[:] == (100, 7)
    assert f", {2 * width})" in plan(judged)


def test_a_batch_is_several_files(spark):
    t = Inputs(spark, "none")
    rows = spark.range(0, 100, 1, 12)
    stream, path = stream_queries.arriving(t, rows, "files")
    assert len(spark.read.parquet(path).inputFiles()) == 12
    numbers = T.latest_per_key(stream.groupBy("id").count(), ["id"], path + "-out")
    assert numbers.agg(F.count("id"), F.sum("count")).first()[:] == (100, 100)
    few, path = stream_queries.arriving(t, spark.range(0, 100, 1, 1), "files")
    assert len(spark.read.parquet(path).inputFiles()) == stream_queries.BATCHES


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(i, f"part {i}", "Brand#1", ("ECONOMY", "SMALL")[i % 2], i) for i in range(50)]
    part = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return Inputs(spark, str(tmp_path))


def test_cells_of_one_file_are_parsed_by_all_tasks(spark, parts):
    assert mining_queries.cells(parts).rdd.getNumPartitions() == shuffle_width(spark)


def test_a_fact_is_moved_once_for_all_scopes(spark):
    items = spark.createDataFrame([(i, i) for i in range(30)], "item_id bigint, idx bigint")
    facts = spark.createDataFrame(
        [(i, p, f"k{(i * p) % 5}", False, 0.1, None if (i + p) % 4 == 0 else f"q{i}-{p}", "x") for i in range(30) for p in range(3)],
        "item_id bigint, pos bigint, knowledge string, knowledgable boolean, knowledge_confidence double, probe_question string, probe_answer string",
    )
    for scopes in ([1, 2, 10], [7, 11, 13]):  # the second ones share no small multiple
        dealt = R.facts_to_inject(items, facts, scopes=scopes)
        known = R.facts_to_inject(R.scope_groups(items, scopes), facts)
        assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, known.collect()), key=repr)
        assert ("_block" in plan(dealt)) == (math.lcm(*scopes) <= R.BLOCK * max(scopes))


def test_pool_reads_texts_of_labelled_facts_only(spark, monkeypatch):
    seen = []
    real = agreement_queries.position_in_group
    monkeypatch.setattr(agreement_queries, "position_in_group", lambda df, *a, **k: (seen.append(set(df.columns)), real(df, *a, **k))[1])

    class Own:
        raters = spark.createDataFrame([(0, "en", "s", 1, 0), (2, "en", "s", -1, 1)], "idx bigint, domain string, task string, label_1 int, label_2 int")
        items = spark.createDataFrame([(1, "BUILDING", "q1"), (2, "BUILDING", None)], "item_id bigint, task string, question string")
        facts = spark.createDataFrame(
            [(1, 0, "k0", "p0", "a0"), (1, 1, "k1", None, "a1"), (2, 0, "k2", "p2", "a2"), (2, 1, "k3", "p3", "a3"), (3, 0, "k", "p", "a")],
            "item_id bigint, pos bigint, knowledge string, probe_question string, probe_answer string",
        )

    got = agreement_queries.pool(Own).select("task", "idx", "llm_label", "question", "context").collect()
    assert sorted(map(tuple, got)) == [
        ("factuality", 0, 1, "p0", "Answer: a0"), ("factuality", 2, 0, "p3", "Answer: a3"), ("necessity", 0, 0, "q1", "Knowledge:\nk0\nk1"),
    ]
    assert {"domain", "item_id", "pos"} in seen
