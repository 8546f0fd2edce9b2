"""Majority votes over sampled answers; the truth of a probe is its order's status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import distributions as H
from lorescope.operators import votes as V
from lorescope.functions import names
from lorescope.plans.registry import Inputs, query
from lorescope.plans.reshape_queries import MODEL_IDS


def truth(t: Inputs) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("probe_id"), F.col("o_orderstatus").alias("gt_answer"))


def verdicts(votes: DataFrame) -> DataFrame:
    return V.read_verdicts(V.distinct_requests(votes, keep=["verdict_text"]))


def evaluated(t: Inputs) -> DataFrame:
    return V.evaluate_judged(t.votes, truth(t))


@query("e1_freq", "SELECT probe_id, answer, count(*) AS freq FROM {votes} GROUP BY probe_id, answer")
def e1(t):
    return V.answer_freq(t.votes)


@query("e2_judge_once", """
    SELECT answer, equivalent, explanation, count(*) AS n_votes, count(DISTINCT probe_id) AS n_requests FROM (
      SELECT probe_id, answer, starts_with(lower(bare), 'yes') AS equivalent, bare AS explanation FROM (
        SELECT *, trim(replace(verdict_text, 'Equivalence:', '')) AS bare FROM {votes}) x) y GROUP BY answer, equivalent, explanation""")
def e2(t):
    votes = t.votes
    judged = verdicts(votes)
    fanned = V.fan_out(votes, judged)
    requests = judged.groupBy("answer", "equivalent", "explanation").agg(F.count(F.lit(1)).alias("n_requests"))
    fanned = fanned.groupBy("answer", "equivalent", "explanation").agg(F.count(F.lit(1)).alias("n_votes"))
    return fanned.join(requests, ["answer", "equivalent", "explanation"])


@query("e3_merge", """
    SELECT probe_id, answer = gt_answer AS is_truth, CASE WHEN answer <> gt_answer THEN answer END AS merged_answer, count(*) AS freq
    FROM {votes} GROUP BY ALL""")
def e3(t):
    votes = t.votes
    return V.merge_equivalent(V.answer_freq(votes), verdicts(votes))


_EVALUATED = """merged AS (SELECT probe_id, answer = gt_answer AS is_truth, CASE WHEN answer <> gt_answer THEN answer END AS txt, count(*) AS freq
      FROM {votes} GROUP BY ALL),
    ranked AS (SELECT *, sum(freq) OVER (PARTITION BY probe_id) AS total, sum(CASE WHEN is_truth THEN freq ELSE 0 END) OVER (PARTITION BY probe_id) AS truths,
      row_number() OVER (PARTITION BY probe_id ORDER BY freq DESC, is_truth DESC, txt) AS rn FROM merged),
    evaluated AS (SELECT o_orderkey AS probe_id, coalesce(total, 0)::BIGINT AS n_votes, coalesce(truths, 0)::BIGINT AS n_truth,
      coalesce(truths / total, 0) AS knowledge_confidence, coalesce(is_truth, false) AS knowledgable,
      CASE WHEN is_truth THEN o_orderstatus ELSE txt END AS majority_answer, coalesce(is_truth, false) AS majority_correct,
      coalesce(freq / total, 0) AS majority_confidence
      FROM {orders} LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r ON o_orderkey = probe_id)"""


@query("e4_kconf", "WITH " + _EVALUATED + """
    SELECT probe_id, n_votes, n_truth, round(knowledge_confidence, 9) AS knowledge_confidence FROM evaluated""")
def e4(t):
    return evaluated(t).select(
        "probe_id", "n_votes", "n_truth", F.round("knowledge_confidence", 9).alias("knowledge_confidence")
    )


@query("e5_majority", "WITH " + _EVALUATED + """
    SELECT probe_id, knowledgable, majority_answer, majority_correct, round(majority_confidence, 9) AS majority_confidence FROM evaluated""")
def e5(t):
    votes = t.votes
    return V.evaluate_probes(votes, verdicts(votes), truth(t)).select(
        "probe_id", "knowledgable", "majority_answer", "majority_correct",
        F.round("majority_confidence", 9).alias("majority_confidence"),
    )


@query("e7_efficacy", """
    WITH raw AS (SELECT probe_id, gt_answer, answer AS old, CASE WHEN gt_answer = 'F' THEN gt_answer ELSE answer END AS new FROM {votes}),
    old_counts AS (SELECT probe_id, gt_answer, old AS a, count(*) AS freq FROM raw GROUP BY ALL),
    new_counts AS (SELECT probe_id, gt_answer, new AS a, count(*) AS freq FROM raw GROUP BY ALL),
    old_best AS (SELECT probe_id, gt_answer, a, row_number() OVER (PARTITION BY probe_id ORDER BY freq DESC, a = gt_answer DESC, a) AS rn FROM old_counts),
    new_best AS (SELECT probe_id, a, row_number() OVER (PARTITION BY probe_id ORDER BY freq DESC, a = gt_answer DESC, a) AS rn FROM new_counts),
    sided AS (SELECT gt_answer, o.a = gt_answer AS kb, n.a = gt_answer AS ka, o.a = n.a AS same
      FROM old_best o JOIN new_best n USING (probe_id) WHERE o.rn = 1 AND n.rn = 1)
    SELECT o_orderstatus AS gt_answer, count(*) AS n, count(*) FILTER (WHERE coalesce(kb, false)) AS known_before,
      count(*) FILTER (WHERE coalesce(ka, false)) AS known_after, count(*) FILTER (WHERE coalesce(same, true)) AS unchanged
    FROM (SELECT gt_answer AS o_orderstatus, kb, ka, same FROM sided
      UNION ALL SELECT o_orderstatus, NULL, NULL, NULL FROM {orders} WHERE o_orderkey NOT IN (SELECT probe_id FROM {votes})) x
    GROUP BY o_orderstatus""")
def e7(t):
    votes = t.votes
    changed = F.when(F.col("gt_answer") == "F", F.col("gt_answer")).otherwise(F.col("answer"))
    said = F.when(changed == F.col("gt_answer"), "Yes.").otherwise("No.")
    after = votes.select("probe_id", said.alias("verdict_text"), changed.alias("answer"))
    effect = V.injection_effect(V.evaluate_judged(votes, truth(t)), V.evaluate_judged(after, truth(t)))
    return effect.join(truth(t), "probe_id").groupBy("gt_answer").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("known_before").alias("known_before"),
        F.count_if("known_after").alias("known_after"),
        F.count_if("unchanged").alias("unchanged"),
    )


def _histogram_sql(by: str) -> str:
    return "WITH " + _EVALUATED + f""",
    shares AS (SELECT {by}, knowledgable, n_votes = 0 AS none, n_truth / greatest(n_votes, 1)::DOUBLE AS share,
        n_votes > 0 AND (20 * n_truth) % greatest(n_votes, 1) = 0 AND (20 * n_truth // greatest(n_votes, 1)) % 2 = 1 AS on_edge FROM evaluated JOIN {{items}} ON probe_id = item_id),
    -- Edges -0.05, 0.05, ..., 1.05: a value belongs to the bin between two of them, one on an edge to the upper one.
    binned AS (SELECT {by}, knowledgable, CASE WHEN none THEN 0 WHEN on_edge THEN (round(20 * share)::INT + 1) // 2
        ELSE len(list_filter(range(1, 11), lambda k: share > -0.05 + 0.1 * k)) END AS bin FROM shares),
    totals AS (SELECT {by}, count(*) AS total FROM binned GROUP BY {by}),
    cells AS (SELECT {by}, bin, count(*) FILTER (WHERE knowledgable) AS k, count(*) FILTER (WHERE NOT knowledgable) AS u FROM binned GROUP BY {by}, bin)
    SELECT t.{by}, b.bin::INT AS bin, coalesce(k, 0) AS known, coalesce(u, 0) AS unknown, round(coalesce(k, 0) / total, 9) AS known_ratio,
      round(coalesce(u, 0) / total, 9) AS unknown_ratio
    FROM totals t CROSS JOIN range(11) b(bin) LEFT JOIN cells c ON c.{by} = t.{by} AND c.bin = b.bin"""


def _histogram(t: Inputs, by: str) -> DataFrame:
    labelled = evaluated(t).join(t.items.select(F.col("item_id").alias("probe_id"), by), "probe_id")
    hist = H.confidence_histogram(labelled, [by])
    return hist.withColumns({c: F.round(c, 9) for c in ("known_ratio", "unknown_ratio")})


@query("h1_kconf_task", _histogram_sql("task"))
def h1(t):
    return _histogram(t, "task")


_FAMILY_SQL = "CASE model WHEN '1-URGENT' THEN 'Llama-3.2 Series' WHEN '2-HIGH' THEN 'Qwen-3 Series' WHEN '3-MEDIUM' THEN 'GPT Series' WHEN '5-LOW' THEN 'GPT Series' END AS family"


@query("h2_kconf_model", f"SELECT *, {_FAMILY_SQL} FROM (" + _histogram_sql("model") + ") h")
def h2(t):
    families = [(m, names.FAMILIES[i]) for m, i in MODEL_IDS.items()]
    known = t.spark.createDataFrame(families, "model string, family string")
    return _histogram(t, "model").join(F.broadcast(known), "model", "left")
