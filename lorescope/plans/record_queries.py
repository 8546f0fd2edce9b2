"""Reading, resuming, patching and reporting of stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorescope.operators import metrics as M
from lorescope.operators.ordering import dense_index, position_in_group
from lorescope.operators.reshape import display_names
from lorescope.plans.metric_queries import BOOTSTRAP_SQL, GRID, LINKS_SQL, REPLICATES, TASKS, fact_matrix, scored
from lorescope.plans.registry import Inputs, query
from lorescope.plans.reshape_queries import MODEL_IDS_SQL, MODEL_NAMES_SQL, model_id, raw_items
from lorescope.session import scratch_path
from lorescope.sources import records as A
from lorescope.sources import report


@query("a1_items", """
    SELECT i.item_id, question AS multihop_question, coalesce(n, 0) AS n_probes, coalesce(asked, 0) AS n_asked
    FROM {items} i LEFT JOIN (SELECT item_id, count(*) AS n, count(probe_question) AS asked FROM {lines} GROUP BY item_id) f ON i.item_id = f.item_id""")
def a1(t):
    path = scratch_path(t.spark, "items")
    raw_items(t).write.json(path)
    probes = F.col("probe_questions")
    return A.sound_items(A.read_items(t.spark, path)).groupBy("item_id", "multihop_question").agg(
        F.sum(F.size(probes)).alias("n_probes"),
        F.sum(F.size(F.filter(probes, lambda p: p["question"].isNotNull()))).alias("n_asked"),
    )


@query("a2_runs_pruned", """
    SELECT task, model, method, scope, count(*) AS n, count(*) FILTER (WHERE final_answer_correct) AS passed
    FROM {items} WHERE method IN ('base', 'mello') AND scope = 10 GROUP BY task, model, method, scope""")
def a2(t):
    path = scratch_path(t.spark, "runs")
    A.write_runs(t.items, path, ["task", "method", "scope"])
    runs = A.read_runs(t.spark, path, {"method": ["base", "mello"], "scope": [10]})
    return runs.groupBy("task", "model", "method", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("final_answer_correct").alias("passed")
    )


@query("a2b_run_names", """
    SELECT lower(task) AS task, method, 500 AS data_size, lower(replace(model, ' ', '')) AS model, scope, count(*) AS n FROM {items} GROUP BY ALL""")
def a2b(t):
    name = F.format_string(
        "data/%s/injection_evaluated/%s_500_%s_%d.pkl", F.lower("task"), "method", F.lower(F.replace("model", F.lit(" "), F.lit(""))), "scope"
    )
    named = t.items.select(name.alias("path"))
    return A.run_key(named, "path").groupBy("task", "method", "data_size", "model", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("a3_annotations", """
    SELECT model, domain, task, (row_number() OVER (PARTITION BY model, domain, task ORDER BY idx) - 1)::INT AS idx, label FROM (
      SELECT 'rater_1' AS model, domain, task, idx, label_1 AS label FROM {raters}
      UNION ALL SELECT 'rater_2', domain, task, idx, label_2 FROM {raters}) x""")
def a3(t):
    path = scratch_path(t.spark, "annotations")
    long = t.raters.selectExpr("domain", "task", "idx as doc", "stack(2, 'rater_1', label_1, 'rater_2', label_2) as (model, label)")
    A.write_annotations(position_in_group(long, ["model", "domain", "task"], ["doc"], "idx"), path)
    return A.read_annotations(t.spark, path)


@query("a4_resume", """
    SELECT task, model, count(*) AS n, count(DISTINCT item_id) AS n_items, count(*) FILTER (WHERE final_answer_correct) AS passed
    FROM {items} GROUP BY task, model""")
def a4(t):
    path = scratch_path(t.spark, "results")
    results = t.items.select("item_id", "task", "model", "final_answer_correct")
    A.append_results(t.items.filter("done").select(*results.columns), path, ["item_id"])
    A.append_results(results, path, ["item_id"])
    stored = A.append_results(results, path, ["item_id"])
    return stored.groupBy("task", "model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("n_items"),
        F.count_if("final_answer_correct").alias("passed"),
    )


@query("a5_patch", """
    SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, item_id, CASE WHEN done THEN 'kept' ELSE 'patched' END AS origin, final_answer_correct AS ap FROM {items}""")
def a5(t):
    items = t.items

    def judge(rows, origin="patched"):
        return rows.select("item_id", F.lit(origin).alias("origin"), M.answer_pass(F.col("final_answer_correct")).alias("ap"))

    patched = A.patch_missing(items, judge(items.filter("done"), "kept"), ["item_id"], judge, order=["item_id"])
    # The place of a row as it comes back: rows before its partition and in it.
    path = scratch_path(t.spark, "patched")
    patched.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return dense_index(t.spark.read.parquet(path), ["_at"], "place", keep=["item_id", "origin", "ap"])


@query("a6_stat_roundtrip", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY event_type""")
def a6(t):
    path, args = scratch_path(t.spark, "stat"), {"stat": "mean", "sample_size": "all"}
    state = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    A.save_stat(state, path, args)
    A.save_stat(state.limit(1), path, {"stat": "mean", "sample_size": "1"})
    loaded = A.load_stat(t.spark, path, args)
    return loaded.select("event_type", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


_SHOWN = ("hp", "ap", "fke")
_CELL = r"""CASE WHEN best THEN printf('\textbf{%.1f} \textsubscript{$\pm$ %.1f}', round_even(round(midpoint, 6), 1), round_even(round(margin, 6), 1))
      ELSE printf('%.1f \textsubscript{$\pm$ %.1f}', round_even(round(midpoint, 6), 1), round_even(round(margin, 6), 1)) END"""


@query("a7_report_rows", BOOTSTRAP_SQL + """,
    named AS (SELECT * REPLACE (CASE method WHEN 'original' THEN 'Base Model' WHEN 'base' THEN CASE WHEN model = '5-LOW' THEN 'Append-T' ELSE 'Append' END ELSE 'MeLLo' END AS method,
        """ + MODEL_NAMES_SQL.replace("CASE model", "CASE " + MODEL_IDS_SQL).replace("ELSE model", "ELSE " + MODEL_IDS_SQL) + f""" AS model) FROM ci),
    flagged AS (SELECT *, abs(midpoint - max(midpoint) OVER (PARTITION BY task, metric)) < 1e-5 AS best FROM named),
    shown AS (SELECT task, model, method, metric, {_CELL} AS cell FROM flagged)
    SELECT model, method, concat(model, ' & ', method""" + "".join(
    f", ' & ', coalesce(max(cell) FILTER (WHERE task = '{t}' AND metric = '{m}'), ' ')" for t in TASKS for m in _SHOWN)
    + r", ' \\') AS line FROM shown GROUP BY model, method")
def a7(t):
    ci = M.bootstrap_hashed(M.cell_counts(scored(t), GRID), GRID, REPLICATES)
    shown = display_names(ci.withColumn("model", model_id(F.col("model"))))
    return report.emit_table(shown.drop("model", "method").withColumnsRenamed({"model_name": "model", "method_name": "method"}), TASKS, _SHOWN)


@query("a8_links", LINKS_SQL + """
    SELECT task, concat('[', string_agg(to_json({{'from': "from", 'to': "to", 'value': value}})::VARCHAR, ', ' ORDER BY to_json({{'from': "from", 'to': "to", 'value': value}})::VARCHAR), ']') AS links
    FROM shares WHERE value > 0 GROUP BY task""".replace("{{", "{").replace("}}", "}"))
def a8(t: Inputs):
    return report.emit_links(M.flow_links(fact_matrix(t)))
