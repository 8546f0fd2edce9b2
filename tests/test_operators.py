"""Operators against brute force on small random or hand-made inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorescope.operators import agreement as G
from lorescope.operators import distributions as H
from lorescope.operators import graph as B
from lorescope.operators import metrics as M
from lorescope.operators import mining as Q
from lorescope.operators import ordering as O
from lorescope.operators import reshape as R
from lorescope.operators import votes as V
from lorescope.sources import report


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("limit", [3, None])
def test_position_in_group(spark, limit):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", rng.randrange(10), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(7)
    got = collected(O.position_in_group(df, ["k"], ["o", "i"], limit=limit), "k", "o", "i", "pos")
    want = []
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        want += [(*r, p) for p, r in enumerate(group)]
    assert got == sorted(want)


def test_dense_index(spark):
    rows = [(i * 7919 % 1009, "a" if i % 3 else "b") for i in range(1009)]
    got = collected(O.dense_index(spark.createDataFrame(rows, "o int, v string").repartition(5), ["o"], "id", keep=["o"]), "o", "id")
    assert got == [(i, i) for i in range(1009)]


ITEM = "item_id bigint, probe_questions array<struct<question string, answer string, knowledge string>>"


def test_flatten_drops_incomplete_facts(spark):
    facts = [
        (1, [Row("q", "a", "k"), Row(None, "a", "k"), Row("q", None, "k"), Row("q2", "a", None)]),
        (2, []), (3, None), (4, [Row("q4", "a", "k")]),
    ]
    out = R.flatten_probes(spark.createDataFrame(facts, ITEM))
    assert collected(out, "id", "complex_question_id", "question", "knowledge") == [
        (0, 1, "q", "k"), (1, 1, "q2", "None"), (2, 4, "q4", "k"),
    ]


def test_nest_keeps_order_in_one_row(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id bigint")
    facts = spark.createDataFrame([(1, p, f"k{p}") for p in reversed(range(3000))], "item_id bigint, pos bigint, knowledge string")
    got = sorted((r["item_id"], [k["knowledge"] for k in r["rk"]]) for r in R.nest(items, facts, ["knowledge"], "rk").collect())
    assert got == [(1, [f"k{p}" for p in range(3000)]), (2, [])]


def test_nest_knowledge_drops_partial_facts_and_items(spark):
    items = spark.createDataFrame([(1, "q", "a"), (2, None, "a"), (3, "q", None)], "item_id bigint, question string, answer string")
    probes = spark.createDataFrame(
        [(1, 0, "k", True, 0.5), (1, 1, None, True, 0.5), (1, 2, "k", None, 0.5), (1, 3, "k", True, None)],
        "item_id bigint, pos bigint, knowledge string, knowledgable boolean, knowledge_confidence double",
    )
    rows = R.nest_knowledge(items, probes).collect()
    assert [(r["item_id"], len(r["required_knowledge"])) for r in rows] == [(1, 1)]


@pytest.mark.parametrize(
    "probes",
    [
        [(1, "a"), (1, "b"), (2, "a")],
        [(1, "a"), (2, "a"), (3, "b"), (1, "b")],
        [(1, "a")] * 20 + [(2, "b")],
        [(1, f"q{i}") for i in range(20)] + [(2, "q3")],
        [(i, "same") for i in range(20)] + [(3, "x")],
        [(random.Random(5).randrange(6), f"q{i % 5}") for i in range(60)],
    ],
)
def test_pair_locality_finds_every_partner(spark, probes):
    rows = [(i, p, q) for i, (p, q) in enumerate(probes)]
    out = R.pair_locality(spark.createDataFrame(rows, "id bigint, complex_question_id bigint, question string"), attempts=1)
    for r in out.collect():
        valid = {i for i, p, q in rows if p != r["complex_question_id"] and q != r["question"]}
        assert r["efficacy_id"] == r["id"]
        assert (r["locality_id"] in valid) if valid else r["locality_id"] is None


def test_pair_locality_on_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, complex_question_id bigint, question string")
    assert R.pair_locality(empty).count() == 0


INJECT = "item_id bigint, pos bigint, knowledge string, knowledgable boolean, knowledge_confidence double, probe_question string, probe_answer string"


def test_first_occurrence_decides_injection(spark):
    items = spark.createDataFrame([(i, i) for i in range(3)], "item_id bigint, idx bigint")
    facts = spark.createDataFrame(
        [
            (0, 0, "a", False, 0.1, None, None),  # seen first, has no probe: suppresses later ones
            (1, 0, "a", False, 0.1, "qa", "x"),
            (1, 1, "b", True, 0.9, "qb", "x"),
            (1, 2, "c", False, 0.1, "qc", "x"),
            (1, 3, "", False, 0.1, "q", "x"),
            (1, 4, "n", None, 0.1, "q", "x"),
            (2, 0, "c", False, 0.1, "later", "x"),
        ],
        INJECT,
    )
    grouped = R.scope_groups(items, [1, 10])
    got = collected(R.facts_to_inject(grouped, facts), "scope", "group_id", "knowledge", "probe_question")
    assert got == [(1, 1, "a", "qa"), (1, 1, "c", "qc"), (1, 2, "c", "later"), (10, 0, "c", "qc")]
    everything = collected(R.facts_to_inject(grouped, facts, only_unknown=False).filter("scope = 10"), "knowledge")
    assert everything == [("b",), ("c",), ("n",)]


def greedy(lengths, budget):
    batches, batch, width = {}, 0, 0
    filled = 0
    for key, length in sorted(lengths, key=lambda r: (-r[1], r[0])):
        if length == 0:
            break
        if width * (filled + 1) > budget:
            batch, filled, width = batch + 1, 0, 0
        if not filled:
            width = length
        batches[key] = batch
        filled += 1
    return batches


@pytest.mark.parametrize("seed, budget, top", [(1, 100, 20), (2, 37, 50), (3, 1000, 5), (4, 10, 60)])
def test_length_batches(spark, seed, budget, top):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(top)) for i in range(400)]
    out = R.length_batches(spark.createDataFrame(rows, "id bigint, n bigint"), "n", budget, ["id"])
    assert {r["id"]: r["batch"] for r in out.collect()} == greedy(rows, budget)


VOTES = "probe_id bigint, answer string, verdict_text string"


def test_majority_ties(spark):
    yes, no = "Yes.", "No."
    votes = [
        (1, "gt", yes), (1, "x", no),  # tie with another answer: the truth wins
        (2, "b", no), (2, "a", no), (2, "c", no), (2, "c", no), (2, "a", no),  # tie of others: smallest text
        (3, "G", yes), (3, "g", yes), (3, "x", no), (3, "x", no), (3, "x", no),  # equal answers count together
    ]
    truth = spark.createDataFrame([(i, "GT") for i in (1, 2, 3, 4)], "probe_id bigint, gt_answer string")
    out = V.evaluate_judged(spark.createDataFrame(votes, VOTES), truth)
    got = {r["probe_id"]: r for r in out.collect()}
    assert (got[1]["majority_answer"], got[1]["knowledgable"], got[1]["majority_confidence"]) == ("GT", True, 0.5)
    assert (got[2]["majority_answer"], got[2]["knowledgable"], got[2]["majority_confidence"]) == ("a", False, 0.4)
    assert (got[3]["majority_answer"], got[3]["knowledge_confidence"]) == ("x", 0.4)
    assert (got[4]["majority_answer"], got[4]["knowledgable"], got[4]["majority_confidence"]) == (None, False, 0.0)


def test_confidence_bins_follow_edges(spark):
    pairs = [(k, n) for n in (1, 3, 10, 20) for k in range(n + 1)] + [(0, 0)]
    df = spark.createDataFrame(pairs, "k bigint, n bigint").withColumn("b", H.confidence_bin(F.col("k"), F.col("n")))
    for r in df.collect():
        exact = 0 if r["n"] == 0 else min((20 * r["k"] + r["n"]) // (2 * r["n"]), 10)
        assert r["b"] == exact


def test_histogram_ratios_sum_to_one(spark):
    rows = [(t, i % 11, 10, i % 2 == 0) for t in "ab" for i in range(37)]
    hist = H.confidence_histogram(spark.createDataFrame(rows, "task string, n_truth bigint, n_votes bigint, knowledgable boolean"), ["task"])
    total = hist.groupBy("task").agg(F.sum(F.col("known_ratio") + F.col("unknown_ratio")).alias("s"), F.count("bin").alias("n"))
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == 11 for r in total.collect())


def test_empty_fact_list_is_entailed(spark):
    df = spark.sql("""SELECT 1 AS i, CAST(array() AS ARRAY<STRUCT<nli_class: STRING>>) AS rk UNION ALL SELECT 2, NULL
        UNION ALL SELECT 3, array(named_struct('nli_class', CAST(NULL AS STRING))) UNION ALL SELECT 4, array(named_struct('nli_class', 'entailment'))""")
    assert collected(df.select("i", M.facts_entailed(F.col("rk")).alias("e")), "i", "e") == [(1, True), (2, False), (3, False), (4, True)]


def test_fact_flow_order(spark):
    classes = ["entailment", "contradiction", "neutral", "entailment", "contradiction"]
    rows = [(1, p, c, p % 2 == 0) for p, c in enumerate(classes)] + [(1, 9, None, True), (1, 10, "neutral", None)]
    flows = M.fact_flows(spark.createDataFrame(rows, "item_id bigint, pos bigint, nli_class string, knowledgable boolean"), "item_id", ["pos"])
    r = flows.collect()[0]
    assert (r["known_entail"], r["known_direct"], r["known_propagated"]) == (1, 0, 2)
    assert (r["unknown_entail"], r["unknown_direct"], r["unknown_propagated"]) == (1, 1, 0)


def test_bootstrap_matches_resampling(spark):
    cells = spark.createDataFrame([("t", 120, 40, 20, 30, 30)], "task string, n bigint, both bigint, ap_only bigint, fke_only bigint, neither bigint")
    items = np.array([(1, 1)] * 40 + [(1, 0)] * 20 + [(0, 1)] * 30 + [(0, 0)] * 30)
    rng = np.random.default_rng(0)
    draws = items[rng.integers(0, 120, size=(4000, 120))]
    want = {"hp": (draws[:, :, 0] & draws[:, :, 1]).mean(1), "ap": draws[:, :, 0].mean(1), "fke": draws[:, :, 1].mean(1)}
    for ci in (M.bootstrap_ci(cells, ["task"], 4000), M.bootstrap_hashed(cells, ["task"], 400)):
        for r in ci.collect():
            low, high = np.percentile(want[r["metric"]] * 100, [2.5, 97.5])
            assert abs(r["lower"] - low) < 2.6 and abs(r["upper"] - high) < 2.6
            assert abs(r["midpoint"] - (r["lower"] + r["upper"]) / 2) < 1e-9
            assert abs(r["margin"] - (r["upper"] - r["lower"]) / 2) < 1e-9


def test_bootstrap_is_reproducible(spark):
    cells = spark.createDataFrame([("a", 10, 3, 3, 2, 2), ("b", 10, 3, 3, 2, 2)], "task string, n bigint, both bigint, ap_only bigint, fke_only bigint, neither bigint")
    one = collected(M.bootstrap_ci(cells, ["task"], 200), "task", "metric", "lower", "upper")
    assert one == collected(M.bootstrap_ci(cells.repartition(5), ["task"], 200), "task", "metric", "lower", "upper")


# 2x2 tables of two judges over 50 samples: both, only first, only second, neither.
GOLDEN = {
    ("code", "factuality"): ((48, 1, 1, 0), -0.0204), ("code", "necessity"): ((44, 2, 2, 2), 0.4565),
    ("math", "factuality"): ((49, 0, 0, 1), 1.0), ("math", "necessity"): ((42, 3, 3, 2), 0.3333),
    ("grow", "factuality"): ((38, 8, 3, 1), 0.0484), ("grow", "necessity"): ((33, 6, 10, 1), -0.0724),
}


def test_agreement_golden(spark):
    rows = []
    for (domain, task), (table, _) in GOLDEN.items():
        labels = [(1, 1)] * table[0] + [(1, 0)] * table[1] + [(0, 1)] * table[2] + [(0, -1)] * table[3]
        for i, (a, b) in enumerate(labels):
            rows += [("one", domain, task, i, a), ("two", domain, task, i, b)]
    long = spark.createDataFrame(rows, "model string, domain string, task string, idx int, label int")
    out = G.cohen_kappa(G.joint_counts(G.pair_raters(long, "one", "two"), ["domain", "task"]))
    for r in out.collect():
        table, kappa = GOLDEN[r["domain"], r["task"]]
        assert (r["n"], r["positive_1"], r["positive_2"], r["joint_positive"]) == (50, table[0] + table[1], table[0] + table[2], table[0])
        assert round(r["kappa"], 4) == kappa


def test_kappa_and_f1_without_variation(spark):
    counts = spark.createDataFrame([(5, 5, 5, 5)], "n bigint, positive_1 bigint, positive_2 bigint, joint_positive bigint")
    assert G.cohen_kappa(counts).collect()[0]["kappa"] is None
    pairs = spark.createDataFrame([("t", 0, 0), ("t", 0, 0)], "task string, label_1 int, label_2 int")
    assert tuple(G.precision_recall_f1(pairs, ["task"]).collect()[0]) == ("t", 2, 0.0, 0.0, 0.0)


TRIPLE = "subj string, prop string, obj string, prop_rank int"


def test_walk_avoids_cycles_and_used_properties(spark):
    edges = [("A", "p", "B", 1), ("B", "q", "A", 1), ("B", "p", "C", 2), ("B", "r", "D", 3), ("D", "q", "E", 1), ("E", "s", "A", 1)]
    starts = spark.createDataFrame([("A",), ("E",), ("Z",)], "id string")
    out = B.walk_chains(starts, spark.createDataFrame(edges, TRIPLE), 4)
    got = {r["start"]: (r["path"], r["props"]) for r in out.collect()}
    assert got["A"] == (["A", "B", "D", "E"], ["p", "r", "q"])
    assert got["E"] == (["E", "A", "B", "D"], ["s", "p", "r"])
    assert got["Z"] == (["Z"], [])


def test_single_valued(spark):
    rows = [("A", "p", "B", 1), ("A", "p", "C", 1), ("A", "q", "B", 2), ("D", "p", "E", 1), ("D", "p", "E", 1)]
    assert collected(B.single_valued(spark.createDataFrame(rows, TRIPLE)), "subj", "prop") == [("A", "q")]


def test_label_limits(spark):
    labels = ["", "one two three four five", "one two three four five six", "x" * 50, "x" * 51]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, t string")
    assert [r[1] for r in df.select("i", B.label_ok(F.col("t"))).orderBy("i").collect()] == [False, True, False, True, False]


def test_descendants_with_cycle(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("x", "y")], "sub string, sup string")
    assert collected(B.descendants(links, ["a", "y"]), "class", "target") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "y")]


def test_similar_entity(spark):
    rows = [(f"e{i}", "big" if i % 4 else "other") for i in range(40)] + [("alone", "single")]
    out = B.similar_entity(spark.createDataFrame(rows, "subj string, class string")).collect()
    kind = dict(rows)
    assert {r["subj"] for r in out} == set(kind) - {"alone"}
    assert all(r["similar"] != r["subj"] and kind[r["similar"]] == kind[r["subj"]] == r["class"] for r in out)


def test_reuse_by_answer(spark):
    rows = [(1, 0, "a", "w1"), (1, 1, "a", "w2"), (2, 0, "a", "w3"), (2, 1, "b", "w4")]
    out = Q.reuse_by_answer(spark.createDataFrame(rows, "item_id bigint, pos bigint, answer string, wording string"), ["wording"])
    assert collected(out, "item_id", "pos", "answer", "wording") == [(1, 0, "a", "w1"), (2, 0, "a", "w1"), (2, 1, "b", "w4")]


def test_math_question_ends_with_stop(spark):
    df = spark.createDataFrame([("Q?", " a plan. "), ("Q?", "a plan")], "q string, p string")
    texts = [r[0] for r in df.select(Q.augment_math_question(F.col("q"), F.col("p"))).collect()]
    assert texts[0] == texts[1] and texts[0].endswith("focus on a plan.")


def test_one_of_two_claims_is_bad(spark):
    triples = spark.createDataFrame(
        [("A", "p", "B", 1), ("A", "p", "C", 1), ("A", "q", "D", 2), ("D", "p", "E", 1), ("E", "q", "F", 2)], "subj string, prop string, obj string, prop_rank int"
    )
    bad = spark.createDataFrame([("A", "p", "B"), ("D", "p", "E")], "subj string, prop string, obj string")
    labels = spark.createDataFrame([(x, f"name {x}") for x in "ABCDEF"], "id string, label string")
    names = spark.createDataFrame([("p", "one"), ("q", "two")], "prop string, prop_label string")
    typed = spark.createDataFrame([("F", "t")], "subj string, target string")
    edges = B.walkable(triples, bad, labels, names, typed, {}, {"q": "t"})
    # A-p has two claims though one is bad; D-p is bad; only F has the class that q asks of its object.
    assert collected(edges, "subj", "prop", "obj") == [("E", "q", "F")]


def test_chains_at_depths(spark):
    edges = spark.createDataFrame([(f"N{i}", f"p{i}", f"N{i + 1}", 1) for i in range(5)], "subj string, prop string, obj string, prop_rank int")
    chains = B.walk_chains(spark.createDataFrame([("N0",), ("N3",), ("X",)], "id string"), edges, 6)
    assert collected(chains.select("start", F.size("props").alias("n")), "start", "n") == [("N0", 5), ("N3", 2), ("X", 0)]
    found = B.at_depths(chains, (2, 3, 4, 5, 6)).select("start", "depth", F.array_join("path", ">").alias("path"))
    assert collected(found, "start", "depth", "path") == [
        ("N0", 2, "N0>N1>N2"), ("N0", 3, "N0>N1>N2>N3"), ("N0", 4, "N0>N1>N2>N3>N4"), ("N0", 5, "N0>N1>N2>N3>N4>N5"), ("N3", 2, "N3>N4>N5"),
    ]


def test_null_answers_keep_their_rows(spark):
    votes = spark.createDataFrame([(1, None), (1, None), (1, "x")], "probe_id int, answer string")
    verdicts = spark.createDataFrame([(1, None, True, "e"), (1, "x", False, "e")], "probe_id int, answer string, equivalent boolean, explanation string")
    assert sorted(r["equivalent"] for r in V.fan_out(votes, verdicts).collect()) == [False, True, True]
    merged = V.merge_equivalent(V.answer_freq(votes), verdicts)
    assert collected(merged, "is_truth", "freq") == [(False, 1), (True, 2)]
    facts = spark.createDataFrame([(1, 0, None, "a"), (2, 0, None, "b"), (2, 1, "y", "c")], "item_id int, pos int, answer string, text string")
    assert collected(Q.reuse_by_answer(facts, ["text"]).fillna("-"), "item_id", "pos", "answer", "text") == [(1, 0, "-", "a"), (2, 0, "-", "a"), (2, 1, "y", "c")]


def test_prompts_with_placeholders_in_questions(spark):
    grouped = spark.createDataFrame([(1, 0, 1, 0, "math", "why [F]?"), (2, 1, 1, 1, "math", "so?")], "item_id int, idx int, scope int, group_id int, task string, question string")
    injected = spark.createDataFrame([(1, 0, 0, 0, "FACT [Q]")], "scope int, group_id int, idx int, pos int, knowledge string")
    found = {r["item_id"]: r["prompt"] for r in R.build_prompt(grouped, injected).collect()}
    assert found[1] == "User:\nwhy [F]?\nPlease update your knowledge with the following facts:\nFACT [Q]\nAssistant:\n"
    assert found[2] == "User:\nso?\nAssistant:\n"


def test_hashed_bootstrap_is_binomial(spark):
    cells = spark.createDataFrame([("a", 400, 100, 60, 40, 200), ("b", 50, 50, 0, 0, 0), ("c", 10**9, 3 * 10**8, 0, 0, 7 * 10**8)],
                                  "run string, n bigint, both bigint, ap_only bigint, fke_only bigint, neither bigint")
    found = {(r["run"], r["metric"]): r for r in M.bootstrap_hashed(cells, ["run"]).collect()}
    rng = np.random.default_rng(0)
    for metric, hits in (("hp", 100), ("ap", 160), ("fke", 140)):
        low, high = np.percentile(rng.binomial(400, hits / 400, 200_000) / 4, [2.5, 97.5])
        assert abs(found["a", metric]["lower"] - low) < 1 and abs(found["a", metric]["upper"] - high) < 1
        assert found["a", metric]["observed"] == hits / 4
    assert found["b", "hp"]["lower"] == found["b", "hp"]["upper"] == 100
    spread = 100 * (0.3 * 0.7 / 10**9) ** 0.5
    assert abs(found["c", "hp"]["lower"] - (30 - 1.96 * spread)) < 0.3 * spread


def test_a_sample_finds_the_large_group(spark, monkeypatch):
    seen = []
    across = O._position_across_tasks
    monkeypatch.setattr(O, "_position_across_tasks", lambda df, *rest: seen.append({r["k"] for r in df.select("k").distinct().collect()}) or across(df, *rest))
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"), "id")
    placed = O.position_in_group(rows, ["k"], ["id"], limit=5000)  # a fifth of the rows is sampled
    assert seen == [{"hot"}]
    assert placed.filter("k = 'hot' and pos * 2 != id").count() == 0
    assert placed.groupBy("k").agg((F.max("pos") + 1 == F.count("*")).alias("dense")).filter("not dense").count() == 0


def test_chains_at_a_hub_do_not_move(spark):
    """A third of the frontier stands at one node: it is found hot, its chains are not shuffled, and the walk is the same."""
    edges = [(f"s{i}", "p", "hub" if i % 3 == 0 else f"n{i}", 0) for i in range(3000)] + [("hub", "q", "end", 0), ("hub", "r", "far", 1)]
    edges += [(f"n{i}", "q", f"m{i}", 0) for i in range(3000)]
    graph = spark.createDataFrame(edges, "subj string, prop string, obj string, prop_rank int")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(3000)], "id string")
    chains = B.walk_chains(starts, graph, 3).collect()
    assert len(chains) == 3000
    for r in chains:
        i = int(r["start"][1:])
        assert r["path"] == ([f"s{i}", "hub", "end"] if i % 3 == 0 else [f"s{i}", f"n{i}", f"m{i}"])
    at = spark.createDataFrame([("hub" if i % 3 == 0 else f"n{i}",) for i in range(3000)], "_at string")
    found = [r["_at"] for r in B.hot_nodes(at, "_at").collect()]
    assert "hub" in found and len(found) <= B.HOT


def test_tables_refuse_a_task_without_a_place(spark):
    cells = spark.createDataFrame(
        [("grow", "m", "base", 1, 4, 2, 1, 1, 0), ("new", "m", "base", 1, 4, 2, 1, 1, 0)],
        "task string, model string, method string, scope int, n long, both long, ap_only long, fke_only long, neither long",
    )
    ci = M.long_rates(cells, ("task", "model", "method")).selectExpr("task", "model", "method", "metric", "rate as midpoint", "0d as margin")
    tables = [lambda t: M.main_table(cells, t), lambda t: M.scope_table(cells, t, [1]), lambda t: report.emit_table(ci, t, M.METRICS)]
    for make in tables:
        assert make(["grow", "new"]).count() == 1
        with pytest.raises(Exception, match="no place for task new"):
            make(["grow"]).collect()
