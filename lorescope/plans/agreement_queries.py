"""Two raters over labelled documents: language as domain, source as task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import agreement as G
from lorescope.operators.ordering import position_in_group
from lorescope.plans.registry import Inputs, query
from lorescope.session import cut_lineage

_LONG = """long AS (SELECT 'rater_1' AS model, domain, task, idx, label_1 AS label FROM {raters}
      UNION ALL SELECT 'rater_2', domain, task, idx, label_2 FROM {raters})"""
_CLEAN = "clean AS (SELECT idx, domain, task, greatest(label_1, 0) AS a, greatest(label_2, 0) AS b FROM {raters})"
_JOINT = """count(*) AS n, count(*) FILTER (WHERE a = 1) AS positive_1, count(*) FILTER (WHERE b = 1) AS positive_2,
      count(*) FILTER (WHERE a = 1 AND b = 1) AS joint_positive"""


def long_labels(t: Inputs) -> DataFrame:
    return t.raters.selectExpr("domain", "task", "idx", "stack(2, 'rater_1', label_1, 'rater_2', label_2) as (model, label)")


def pairs(t: Inputs) -> DataFrame:
    return G.pair_raters(long_labels(t), "rater_1", "rater_2")


@query("r1_positive", "WITH " + _LONG + """
    SELECT model, domain, task, count(label) AS n, sum(greatest(label, 0))::BIGINT AS positives, round(avg(greatest(label, 0)), 9) AS positive_rate
    FROM long GROUP BY model, domain, task""")
def r1(t):
    return G.positive_rate(long_labels(t)).withColumn("positive_rate", F.round("positive_rate", 9))


@query("r2_joint", "WITH " + _CLEAN + f" SELECT domain, task, {_JOINT} FROM clean GROUP BY domain, task")
def r2(t):
    return G.joint_counts(pairs(t), ["domain", "task"])


@query("r3_rollup", "WITH " + _CLEAN + f" SELECT task, domain, {_JOINT} FROM clean GROUP BY ROLLUP (task, domain)")
def r3(t):
    return G.joint_counts(pairs(t), ["task", "domain"], rollup=True)


@query("r4_kappa", "WITH " + _CLEAN + f""", counts AS (SELECT domain, task, {_JOINT} FROM clean GROUP BY ROLLUP (domain, task)),
    shares AS (SELECT *, positive_1 / n AS p1, positive_2 / n AS p2, joint_positive / n AS pj FROM counts)
    SELECT domain, task, n, positive_1, positive_2, joint_positive, CASE WHEN 1 - (p1 * p2 + (1 - p1) * (1 - p2)) <> 0 THEN
      round((pj + (1 - p1 - p2 + pj) - (p1 * p2 + (1 - p1) * (1 - p2))) / (1 - (p1 * p2 + (1 - p1) * (1 - p2))), 6) END AS kappa FROM shares""")
def r4(t):
    return G.cohen_kappa(G.joint_counts(pairs(t), ["domain", "task"], rollup=True)).withColumn("kappa", F.round("kappa", 6))


@query("r5_prf", "WITH " + _CLEAN + """, counts AS (SELECT task, count(*) AS n, count(*) FILTER (WHERE a = 1 AND b = 1) AS hit,
      count(*) FILTER (WHERE a = 1) AS said, count(*) FILTER (WHERE b = 1) AS truly FROM clean GROUP BY task)
    SELECT task, n, round(CASE WHEN said = 0 THEN 0 ELSE hit / said END, 9) AS precision, round(CASE WHEN truly = 0 THEN 0 ELSE hit / truly END, 9) AS recall,
      round(CASE WHEN said + truly = 0 THEN 0 ELSE 2 * hit / (said + truly) END, 9) AS f1 FROM counts""")
def r5(t):
    scores = G.precision_recall_f1(pairs(t), ["task"])
    return scores.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


CODE_DOMAIN = "MACHINERY"
DOMAINS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

_POOL = """labelled AS (SELECT 'judge' AS model, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS domain,
      unnest_task AS task, idx, CASE unnest_task WHEN 'factuality' THEN label_1 ELSE label_2 END AS label
      FROM {raters}, (VALUES ('factuality'), ('necessity')) v(unnest_task)),
    probes AS (SELECT task AS domain, row_number() OVER (PARTITION BY task ORDER BY item_id, pos) - 1 AS idx, probe_question AS question, probe_answer AS answer
      FROM {facts} JOIN {items} USING (item_id) WHERE probe_question IS NOT NULL),
    asked AS (SELECT task AS domain, row_number() OVER (PARTITION BY task ORDER BY item_id) - 1 AS idx, item_id, question FROM {items}),
    texts AS (SELECT item_id, string_agg(knowledge, chr(10) ORDER BY pos) AS k, string_agg(probe_answer, chr(10) ORDER BY pos) AS c FROM {facts} GROUP BY item_id),
    pool AS (SELECT model, l.domain, task, l.idx, greatest(label, 0) AS llm_label, question, concat('Answer: ', answer) AS context
        FROM labelled l JOIN probes p ON l.domain = p.domain AND l.idx = p.idx WHERE task = 'factuality'
      UNION ALL SELECT model, l.domain, task, l.idx, greatest(label, 0), question,
        CASE WHEN l.domain = 'MACHINERY' THEN concat('Function Calls:', chr(10), coalesce(c, '')) ELSE concat('Knowledge:', chr(10), coalesce(k, '')) END
        FROM labelled l JOIN asked a ON l.domain = a.domain AND l.idx = a.idx LEFT JOIN texts x ON a.item_id = x.item_id WHERE task = 'necessity')"""


def pool(t: Inputs) -> DataFrame:
    """The annotation pool. Facts are placed once and their order takes keys alone; texts are read for labelled ones."""
    labels = t.raters.withColumn("domain", F.explode(F.array(*[F.lit(d) for d in DOMAINS]))).selectExpr(
        "'judge' as model", "domain", "idx", "stack(2, 'factuality', label_1, 'necessity', label_2) as (task, label)"
    )
    labels, items = cut_lineage(labels), t.items.withColumnRenamed("task", "domain")
    facts = cut_lineage(t.facts.select("item_id", "pos", "knowledge", "probe_question", "probe_answer"))
    asked = facts.filter("probe_question is not null").join(items.select("item_id", "domain"), "item_id")
    places = position_in_group(cut_lineage(asked.select("domain", "item_id", "pos")), ["domain"], ["item_id", "pos"], "idx")
    labelled = labels.filter("task = 'factuality'").select("domain", "idx").distinct()
    probes = cut_lineage(places.join(labelled, ["domain", "idx"], "left_semi")).join(facts, ["item_id", "pos"])
    probes = probes.select("domain", "idx", F.col("probe_question").alias("question"), F.col("probe_answer").alias("answer"))
    numbered = position_in_group(items.select("domain", "item_id", "question"), ["domain"], ["item_id"], "idx")
    return G.annotation_pool(labels, probes, numbered, facts.withColumnRenamed("probe_answer", "answer"), [CODE_DOMAIN])


@query("r6_pool", "WITH " + _POOL + "SELECT * FROM pool")
def r6(t):
    return pool(t)


@query("r7_sample", "WITH " + _POOL + """
    SELECT model, domain, task, idx, llm_label, question, context FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY
      ('0x' || substr(md5(concat_ws('|', domain, idx)), 1, 15))::BIGINT, domain, idx) AS rn FROM pool) x WHERE rn <= 50""")
def r7(t):
    return G.sample_per_task(pool(t), 50, ["domain", "idx"])
