"""Run metrics over items and their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import metrics as M
from lorescope.plans.registry import Inputs, query
from lorescope.plans.views import LINE_ORDER

TASKS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SCOPES = (1, 10, 100, 500)
REPLICATES = 1000
GRID = ("task", "model", "method")


def scored(t: Inputs) -> DataFrame:
    return M.score_items(t.items, t.classes)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("m1_ap", """
    SELECT task, model, count(*) AS n, count(*) FILTER (WHERE ap) AS passed FROM {scored} GROUP BY task, model""")
def m1(t):
    items = t.items.withColumn("ap", M.answer_pass(F.col("final_answer_correct")))
    return items.groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if("ap").alias("passed"))


@query("m2_fke", """
    SELECT task, model, count(*) AS n, count(*) FILTER (WHERE fke) AS entailed FROM {scored} GROUP BY task, model""")
def m2(t):
    return scored(t).groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if("fke").alias("entailed"))


@query("m3_hp", """
    SELECT item_id, ap, fke, hp FROM {scored}""")
def m3(t):
    return scored(t).select("item_id", "ap", "fke", "hp")


@query("m4_rates", """
    SELECT task, model, method, scope, count(*) AS n, round(avg(hp::INT), 6) AS hp, round(avg(ap::INT), 6) AS ap,
      round(avg(fke::INT), 6) AS fke FROM {scored} GROUP BY task, model, method, scope""")
def m4(t):
    return rounded(M.rates(M.cell_counts(scored(t), M.RUN_KEY)), *M.METRICS)


_CELLS = """cells AS (SELECT task, model, method, count(*) AS n, count(*) FILTER (WHERE ap AND fke) AS both_ok,
      count(*) FILTER (WHERE ap AND NOT fke) AS ap_only, count(*) FILTER (WHERE fke AND NOT ap) AS fke_only
      FROM {scored} GROUP BY task, model, method)"""

_PLACES = M.interval_places(REPLICATES)
_SEEN = """seen AS (SELECT task, model, method, 'hp' AS metric, both_ok::DOUBLE AS hits, n::DOUBLE AS n FROM cells
      UNION ALL SELECT task, model, method, 'ap', (both_ok + ap_only)::DOUBLE, n::DOUBLE FROM cells
      UNION ALL SELECT task, model, method, 'fke', (both_ok + fke_only)::DOUBLE, n::DOUBLE FROM cells)"""

# Draws at the places of the two percentiles among 1000 sorted ones, by inverting the binomial distribution of hits.
BOOTSTRAP_SQL = "WITH " + _CELLS + ", " + _SEEN + f""",
    draws AS (SELECT task, model, method, metric, ('0x' || substr(md5(concat_ws('|', task, model, method, metric, rep)), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
      FROM seen, range({REPLICATES}) r(rep)),
    sorted AS (SELECT *, row_number() OVER (PARTITION BY task, model, method, metric ORDER BY u) - 1 AS place FROM draws),
    counted AS (SELECT *, hits / n AS p, unnest(range(0, n::BIGINT + 1))::DOUBLE AS k FROM seen),
    chances AS (SELECT *, CASE WHEN hits = 0 OR hits = n THEN (k = hits)::INT::DOUBLE ELSE {M.binomial_sql('n', 'k', 'p')} END AS chance FROM counted),
    summed AS (SELECT *, sum(chance) OVER (PARTITION BY task, model, method, metric ORDER BY k) AS cdf FROM chances),
    found AS (SELECT d.task, d.model, d.method, d.metric, place, min(k) AS hits FROM sorted d JOIN summed s
        ON d.task = s.task AND d.model = s.model AND d.method = s.method AND d.metric = s.metric AND cdf >= u
      WHERE place IN ({", ".join(str(p) for a, b, _ in _PLACES for p in (a, b))}) GROUP BY ALL),
    bounds AS (SELECT task, model, method, metric, """ + ", ".join(
    f"max(hits) FILTER (WHERE place = {a}) + {part!r} * (max(hits) FILTER (WHERE place = {b}) - max(hits) FILTER (WHERE place = {a})) AS {name}"
    for name, (a, b, part) in zip(("low", "high"), _PLACES)) + """ FROM found GROUP BY ALL),
    ci AS (SELECT s.task, s.model, s.method, s.metric, s.hits * 100 / n AS observed, low * 100 / n AS lower, high * 100 / n AS upper,
        (low + high) / 2 * 100 / n AS midpoint, (high - low) / 2 * 100 / n AS margin
      FROM bounds b JOIN seen s ON s.task = b.task AND s.model = b.model AND s.method = b.method AND s.metric = b.metric)"""


@query("m5_bootstrap", BOOTSTRAP_SQL + """
    SELECT task, model, method, metric, round(observed, 6) AS observed, round(lower, 6) AS lower, round(upper, 6) AS upper,
      round(midpoint, 6) AS midpoint, round(margin, 6) AS margin FROM ci""")
def m5(t):
    ci = M.bootstrap_hashed(M.cell_counts(scored(t), GRID), GRID, REPLICATES)
    return rounded(ci, "observed", "lower", "upper", "midpoint", "margin")


# How far a percentile of 1000 multinomial draws may lie from that of the normal distribution: its own spread, about
# 0.085 standard deviations, five times, and one item for the steps of counts.
_NEAR = "abs({bound} - ({rate} {sign} 1.959964 * {sd})) <= 0.45 * {sd} + 100.0 / n"


@query("m5b_multinomial", """
    WITH cells AS (SELECT task, model, method, scope, count(*) AS n, count(*) FILTER (WHERE ap AND fke) AS hp, count(*) FILTER (WHERE ap) AS ap,
      count(*) FILTER (WHERE fke) AS fke FROM {scored} GROUP BY ALL),
    long AS (UNPIVOT cells ON hp, ap, fke INTO NAME metric VALUE hits)
    SELECT task, model, method, scope, metric, n, round(hits * 100 / n, 6) AS observed, true AS lower_near, true AS upper_near FROM long""")
def m5b(t):
    cells = M.cell_counts(scored(t), M.RUN_KEY)
    ci = M.bootstrap_ci(cells, M.RUN_KEY, REPLICATES).join(cells.select(*M.RUN_KEY, "n"), list(M.RUN_KEY))
    sd = "sqrt(observed * (100 - observed) / n)"
    return rounded(ci, "observed").select(
        *M.RUN_KEY, "metric", "n", "observed",
        F.expr(_NEAR.format(bound="lower", rate="observed", sign="-", sd=sd)).alias("lower_near"),
        F.expr(_NEAR.format(bound="upper", rate="observed", sign="+", sd=sd)).alias("upper_near"),
    )


@query("m6_main_table", "SELECT model, method, " + ", ".join(
    f"round(avg({m}::INT * 100.0) FILTER (WHERE task = '{t}'), 6) AS {t}_{m.upper()}" for t in TASKS for m in M.METRICS)
    + " FROM {scored} GROUP BY model, method")
def m6(t):
    table = M.main_table(M.cell_counts(scored(t), GRID), TASKS)
    return rounded(table, *[c for c in table.columns if c not in ("model", "method")])


_LONG = "WITH " + _CELLS + """,
    long AS (SELECT task, model, method, 'hp' AS metric, both_ok * 100 / n AS rate FROM cells
      UNION ALL SELECT task, model, method, 'ap', (both_ok + ap_only) * 100 / n FROM cells
      UNION ALL SELECT task, model, method, 'fke', (both_ok + fke_only) * 100 / n FROM cells)"""


@query("m7_best", _LONG + """
    SELECT task, model, method, metric, round(rate, 6) AS rate,
      abs(rate - max(rate) OVER (PARTITION BY task, metric)) < 1e-5 AS best FROM long""")
def m7(t):
    long = M.long_rates(M.cell_counts(scored(t), GRID), GRID)
    return rounded(M.best_in_column(long, "rate", ("task", "metric")), "rate")


@query("m8_scope_table", "SELECT model, method, " + ", ".join(
    f"round(avg(hp::INT * 100.0) FILTER (WHERE task = '{t}' AND scope = {s}), 6) AS {t}_{s}" for t in TASKS for s in SCOPES)
    + " FROM {scored} GROUP BY model, method")
def m8(t):
    table = M.scope_table(M.cell_counts(scored(t), M.RUN_KEY), TASKS, SCOPES)
    return rounded(table, *[c for c in table.columns if c not in ("model", "method")])


TRANSITION_SQL = """
    SELECT task, kind, source, target, count(*) FILTER (WHERE fke = (source = 'entailed')
      AND (CASE kind WHEN 'ap' THEN ap ELSE hp END) = (target = 'correct')) AS value
    FROM {scored}, (VALUES ('ap'), ('hp')) k(kind), (VALUES ('entailed'), ('failed')) s(source), (VALUES ('correct'), ('wrong')) g(target)
    GROUP BY task, kind, source, target"""


@query("m9_transition", TRANSITION_SQL)
def m9(t):
    return M.answer_transition(M.cell_counts(scored(t), ["task"]))


FACT_FLOW_SQL = """
    SELECT task, source, target, count(*) FILTER (WHERE s = source AND g = target) AS value FROM (
      SELECT task, CASE WHEN knowledgable THEN 'known' ELSE 'unknown' END AS s,
        CASE WHEN nli_class = 'entailment' THEN 'entail' WHEN coalesce(sum((nli_class <> 'entailment')::INT) OVER
          (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'propagated' ELSE 'direct' END AS g
      FROM {facts} JOIN {items} USING (item_id)) x,
      (VALUES ('known'), ('unknown')) a(source), (VALUES ('entail'), ('direct'), ('propagated')) b(target)
    GROUP BY task, source, target"""


def fact_matrix(t: Inputs) -> DataFrame:
    return M.fact_transition(t.items, M.fact_flows(t.classes, "item_id", LINE_ORDER), "item_id")


@query("m10_fact_transition", FACT_FLOW_SQL)
def m10(t):
    return fact_matrix(t)


LINKS_SQL = "WITH flow AS (" + FACT_FLOW_SQL + """),
    shares AS (SELECT task, value,
      printf('%s' || chr(10) || '%.1f%%', source, round_even(round(sum(value) OVER (PARTITION BY task, source) * 100 / sum(value) OVER (PARTITION BY task), 6), 1)) AS "from",
      printf('%s' || chr(10) || '%.1f%%', target, round_even(round(sum(value) OVER (PARTITION BY task, target) * 100 / sum(value) OVER (PARTITION BY task), 6), 1)) AS "to" FROM flow)"""


@query("m11_links", LINKS_SQL + """
    SELECT task, "from", "to", value FROM shares WHERE value > 0""")
def m11(t):
    return M.flow_links(fact_matrix(t))


@query("m12_dataset_stats", """
    WITH counted AS (SELECT item_id, count(*) AS n, sum(len(regexp_extract_all(probe_question, '\\S+'))) AS pw,
        sum(len(regexp_extract_all(knowledge, '\\S+'))) AS fw FROM {lines} GROUP BY item_id)
    SELECT task, count(*) AS n_items, round(sum(n) / count(*), 6) AS facts_per_item,
      round(avg(len(regexp_extract_all(question, '\\S+'))), 6) AS question_words,
      round(sum(pw) / sum(n), 6) AS probe_words, round(sum(fw) / sum(n), 6) AS fact_words
    FROM {items} LEFT JOIN counted USING (item_id) GROUP BY task""")
def m12(t):
    stats = M.dataset_stats(t.items, t.lines, "item_id")
    return rounded(stats, "facts_per_item", "question_words", "probe_words", "fact_words")


@query("m13_exemplars", """
    WITH per AS (SELECT item_id, count(*) FILTER (WHERE nli_class = 'entailment') AS e, count(*) FILTER (WHERE nli_class <> 'entailment') AS f
        FROM {lines} GROUP BY item_id),
    hits AS (SELECT item_id, 'entail' AS class FROM per WHERE e > 0 UNION ALL SELECT item_id, 'direct' FROM per WHERE f > 0
        UNION ALL SELECT item_id, 'propagated' FROM per WHERE f > 1),
    ranked AS (SELECT task, class, item_id, row_number() OVER (PARTITION BY task, class ORDER BY model, scope, item_id)::INT AS place
        FROM hits JOIN {items} USING (item_id))
    SELECT task, class, place, item_id FROM ranked WHERE place <= 5""")
def m13(t):
    return M.exemplars(t.items, t.lines, "item_id", ("model", "scope", "item_id"))


@query("m14_delta", _LONG + """
    SELECT a.task, a.model, a.method, a.metric, round(a.rate, 6) AS rate, round(b.rate, 6) AS base_rate,
      round(a.rate - b.rate, 6) AS delta FROM long a LEFT JOIN long b
      ON a.task = b.task AND a.model = b.model AND a.metric = b.metric AND b.method = 'original' WHERE a.method <> 'original'""")
def m14(t):
    return rounded(M.compare_runs(M.cell_counts(scored(t), GRID)), "rate", "base_rate", "delta")
