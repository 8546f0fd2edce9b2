"""Nesting, pairing, scope groups, prompts, grids and batches over items and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.functions import names
from lorescope.operators import reshape as R
from lorescope.operators.ordering import dense_index
from lorescope.plans.registry import Inputs, query
from lorescope.plans.views import LINE_ORDER

SCOPES = (1, 10, 100, 500)


def raw_items(t: Inputs) -> DataFrame:
    """Items with their probe questions nested, as the files of a test set hold them."""
    probes = t.facts.select(
        "item_id", "pos", F.col("probe_question").alias("question"), F.col("probe_answer").alias("answer"), "knowledge"
    )
    items = t.items.select("item_id", F.col("question").alias("multihop_question"), F.col("gt_answer").alias("multihop_answer"))
    return R.nest(items, probes, ["question", "answer", "knowledge"], "probe_questions")


def flat_probes(t: Inputs) -> DataFrame:
    """Every fact as a probe whose question is the fact text, with a dense id."""
    numbered = dense_index(t.lines, ["item_id", *LINE_ORDER], "id", keep=["item_id", "knowledge", "probe_answer"])
    return numbered.select(
        "id", F.col("item_id").alias("complex_question_id"), F.col("knowledge").alias("question"), F.col("probe_answer").alias("answer")
    )


def indexed_items(t: Inputs) -> DataFrame:
    return dense_index(t.items, ["item_id"], "idx")


@query("c1_flatten", """
    SELECT row_number() OVER (ORDER BY item_id, pos) - 1 AS id, item_id AS complex_question_id, probe_question AS question,
      probe_answer AS answer, knowledge FROM {facts} WHERE probe_question IS NOT NULL AND probe_answer IS NOT NULL""")
def c1(t):
    return R.flatten_probes(raw_items(t))


@query("c2_nest", """
    SELECT i.item_id AS id, question, gt_answer AS answer, coalesce(n_facts, 0) AS n_facts, coalesce(body, '') AS body
    FROM {items} i LEFT JOIN (SELECT item_id, count(*) AS n_facts, string_agg(concat(knowledge, ':', CASE WHEN knowledgable THEN 'known' ELSE 'unknown' END, ':',
      round(knowledge_confidence * 100)::INT), '|' ORDER BY pos) AS body FROM {facts} GROUP BY ALL) f ON i.item_id = f.item_id
    WHERE question IS NOT NULL""")
def c2(t):
    items = t.items.select("item_id", "question", F.col("gt_answer").alias("answer"))
    nested = R.nest_knowledge(items, t.facts)
    line = F.transform(
        "required_knowledge",
        lambda k: F.concat_ws(
            ":", k["knowledge"], F.when(k["knowledgable"], "known").otherwise("unknown"),
            F.round(k["knowledge_confidence"] * 100).cast("int").cast("string"),
        ),
    )
    return nested.select(
        F.col("item_id").alias("id"), "question", "answer",
        F.size("required_knowledge").cast("bigint").alias("n_facts"), F.array_join(line, "|").alias("body"),
    )


_PAIRS = """probes AS (SELECT row_number() OVER (ORDER BY item_id, pos) - 1 AS id, item_id AS p, knowledge AS q, probe_answer AS answer FROM {facts}),
    size AS (SELECT count(*) AS n FROM probes),
    tries AS (SELECT id, p, q, k, (id + 1 + ('0x' || substr(md5(concat_ws('|', id, k)), 1, 15))::BIGINT % (n - 1)) % n AS other
      FROM probes, size, (VALUES (1), (2), (3)) a(k)),
    picked AS (SELECT t.id, min_by(t.other, t.k) AS other FROM tries t JOIN probes o ON t.other = o.id
      WHERE t.p <> o.p AND t.q <> o.q GROUP BY t.id),
    head AS (SELECT * FROM probes ORDER BY id LIMIT 1),
    s1 AS (SELECT x.* FROM probes x, head WHERE x.p <> head.p ORDER BY id LIMIT 1),
    t1 AS (SELECT x.* FROM probes x, head WHERE x.q <> head.q ORDER BY id LIMIT 1),
    s2 AS (SELECT x.* FROM probes x, head, s1 WHERE x.p <> head.p AND x.q <> s1.q ORDER BY x.id LIMIT 1),
    t2 AS (SELECT x.* FROM probes x, head, t1 WHERE x.q <> head.q AND x.p <> t1.p ORDER BY x.id LIMIT 1),
    witnesses AS (SELECT 1 AS w, * FROM head UNION ALL SELECT 2, * FROM s1 UNION ALL SELECT 3, * FROM s2
      UNION ALL SELECT 4, * FROM t1 UNION ALL SELECT 5, * FROM t2),
    rest AS (SELECT r.id, min_by(w.id, w.w) AS other FROM probes r JOIN witnesses w ON r.p <> w.p AND r.q <> w.q
      WHERE r.id NOT IN (SELECT id FROM picked) GROUP BY r.id),
    pairs AS (SELECT r.id, r.p, r.q, r.id AS efficacy_id, coalesce(k.other, s.other) AS locality_id
      FROM probes r LEFT JOIN picked k ON r.id = k.id LEFT JOIN rest s ON r.id = s.id)"""


@query("c3_pairs", """
    WITH probes AS (SELECT row_number() OVER (ORDER BY item_id, pos) - 1 AS id, item_id AS p, knowledge AS q FROM {facts}),
    counted AS (SELECT *, count(*) OVER () - count(*) OVER (PARTITION BY p) - count(*) OVER (PARTITION BY q) + count(*) OVER (PARTITION BY p, q) AS partners FROM probes)
    SELECT id, p AS complex_question_id, q AS question, id AS efficacy_id, partners > 0 AS paired, partners > 0 AS valid FROM counted""")
def c3(t):
    pairs = R.pair_locality(flat_probes(t)).select("id", "complex_question_id", "question", "efficacy_id", "locality_id")
    others = pairs.select(F.col("id").alias("locality_id"), F.col("complex_question_id").alias("op"), F.col("question").alias("oq"))
    differs = (F.col("op") != F.col("complex_question_id")) & (F.col("oq") != F.col("question"))
    return pairs.join(others, "locality_id", "left").select(
        "id", "complex_question_id", "question", "efficacy_id", F.col("locality_id").isNotNull().alias("paired"), F.coalesce(differs, F.lit(False)).alias("valid")
    )


@query("c4_pair_lookup", "WITH " + _PAIRS + """
    SELECT a.id, a.efficacy_id, a.locality_id, e.q AS efficacy_question, e.answer AS efficacy_answer, l.q AS locality_question, l.answer AS locality_answer
    FROM pairs a JOIN probes e ON a.efficacy_id = e.id JOIN probes l ON a.locality_id = l.id""")
def c4(t):
    probes = flat_probes(t)
    return R.lookup_pairs(R.pair_locality(probes), probes)


_GROUPED = """indexed AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM {items}),
    grouped AS (SELECT i.item_id, i.idx, i.task, i.question, s.scope::INT AS scope, i.idx // s.scope AS group_id FROM indexed i, (VALUES (1), (10), (100), (500)) s(scope))"""


@query("c5_scope_groups", "WITH " + _GROUPED + """
    SELECT scope, group_id, count(*) AS n, min(item_id) AS first_item, max(item_id) AS last_item FROM grouped GROUP BY scope, group_id""")
def c5(t):
    return R.scope_groups(indexed_items(t), SCOPES).groupBy("scope", "group_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item")
    )


def _injected_sql(where: str) -> str:
    return "WITH " + _GROUPED + f""",
    seen AS (SELECT scope, group_id, knowledge, idx, pos, knowledgable, probe_question, probe_answer,
        row_number() OVER (PARTITION BY scope, group_id, knowledge ORDER BY idx, pos) AS rn
      FROM grouped JOIN {{facts}} USING (item_id) WHERE knowledge <> '' AND {where}),
    injected AS (SELECT * FROM seen WHERE rn = 1 AND probe_question IS NOT NULL)"""


_INJECT_COLUMNS = ("scope", "group_id", "knowledge", "idx", "pos", "knowledgable", "probe_question", "probe_answer")


@query("c6_unknown", _injected_sql("NOT knowledgable") + f"SELECT {', '.join(_INJECT_COLUMNS)} FROM injected")
def c6(t):
    return R.facts_to_inject(indexed_items(t), t.facts, scopes=SCOPES).select(*_INJECT_COLUMNS)


@query("c7_all_facts", _injected_sql("true") + f"SELECT {', '.join(_INJECT_COLUMNS)} FROM injected")
def c7(t):
    return R.facts_to_inject(indexed_items(t), t.facts, only_unknown=False, scopes=SCOPES).select(*_INJECT_COLUMNS)


@query("c8_prompt", _injected_sql("NOT knowledgable") + """,
    texts AS (SELECT scope, group_id, string_agg(knowledge, ' ' ORDER BY idx, pos) AS facts FROM injected GROUP BY scope, group_id)
    SELECT item_id, scope, length(prompt) AS chars, md5(prompt) AS digest FROM (
      SELECT item_id, scope, concat('User:', chr(10), question, chr(10), CASE WHEN facts IS NULL THEN '' ELSE
        concat(CASE WHEN task = 'MACHINERY' THEN 'Please update your knowledge with following facts:' ELSE 'Please update your knowledge with the following facts:' END,
          chr(10), facts, chr(10)) END, 'Assistant:', chr(10)) AS prompt
      FROM grouped LEFT JOIN texts USING (scope, group_id) WHERE question IS NOT NULL) x""")
def c8(t):
    items = indexed_items(t)
    grouped = R.scope_groups(items, SCOPES)
    injected = R.facts_to_inject(items, t.facts, scopes=SCOPES)
    prompts = R.build_prompt(grouped, injected, code_tasks=("MACHINERY",)).filter("prompt is not null")
    return prompts.select("item_id", "scope", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("digest"))


@query("c9_context", """
    SELECT f.item_id, pos, nli_class, probe_answer, question FROM {facts} f JOIN {items} i ON f.item_id = i.item_id""")
def c9(t):
    facts = t.facts
    judged = facts.select("item_id", "pos", "nli_class")
    raw = facts.select("item_id", "pos", "probe_answer")
    with_facts = R.attach_context(judged, raw, ["item_id", "pos"])
    return R.attach_context(with_facts, t.items.select("item_id", "question"), ["item_id"])


GRID = ("task", "model", "method", "scope")
_GRID_SQL = """grid AS (SELECT DISTINCT a.task, b.model, c.method, d.scope FROM (SELECT DISTINCT task FROM {items}) a, (SELECT DISTINCT model FROM {items}) b,
      (SELECT DISTINCT method FROM {items}) c, (SELECT DISTINCT scope FROM {items}) d
      UNION SELECT DISTINCT a.task, b.model, 'base', 1 FROM (SELECT DISTINCT task FROM {items}) a, (SELECT DISTINCT model FROM {items}) b)"""


def grid(t: Inputs) -> DataFrame:
    return R.experiment_grid(t.items, GRID, {"method": "base", "scope": 1})


@query("c10_grid", "WITH " + _GRID_SQL + "SELECT * FROM grid")
def c10(t):
    return grid(t)


@query("c11_completeness", "WITH " + _GRID_SQL + """,
    stored AS (SELECT task, model, method, scope, count(*) FILTER (WHERE question IS NOT NULL) AS n_in,
      count(*) FILTER (WHERE question IS NOT NULL AND done) AS n_out FROM {items} GROUP BY ALL)
    SELECT task, model, method, scope, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out,
      CASE WHEN coalesce(n_in, 0) = 0 THEN 'No Input' WHEN n_out >= n_in THEN 'Complete' ELSE 'Pending' END AS status
    FROM grid LEFT JOIN stored USING (task, model, method, scope)""")
def c11(t):
    asked = t.items.filter("question is not null")
    return R.completeness(grid(t), asked, asked.filter("done"), GRID)


# Part types stand for model lines, part sizes for billions of parameters.
_LINES = {"PROMO": "llama-3.2", "SMALL": "qwen-2.5", "ECONOMY": "qwen-3"}
_SIZE_SQL = "regexp_extract(model, '(\\d+(\\.\\d+)?)b', 1)"


@query("c12_model_dim", f"""
    SELECT model, CASE model {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.MODEL_ALIASES.items())} ELSE model END AS full_name,
      TRY_CAST({_SIZE_SQL} AS DOUBLE) AS size_b, n_parts,
      CASE {_SIZE_SQL} WHEN '' THEN 12.0::DOUBLE WHEN '7' THEN 30.0 WHEN '11' THEN 30.0 ELSE 4 * TRY_CAST({_SIZE_SQL} AS DOUBLE) END AS memory_gb
    FROM (SELECT concat(CASE p_type WHEN 'PROMO' THEN 'llama-3.2' WHEN 'SMALL' THEN 'qwen-2.5' WHEN 'ECONOMY' THEN 'qwen-3' ELSE lower(p_type) END,
        CASE WHEN p_size > 40 THEN '' ELSE concat('-', p_size, CASE WHEN p_type = 'LARGE' THEN '.5b' ELSE 'b' END) END) AS model,
      count(*) AS n_parts FROM {{part}} GROUP BY 1) x""")
def c12(t):
    line = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in _LINES.items()], F.lower("p_type"))
    suffix = F.when(F.col("p_type") == "LARGE", ".5b").otherwise("b")
    size = F.when(F.col("p_size") > 40, "").otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"), suffix))
    models = t.part.groupBy(F.concat(line, size).alias("model")).agg(F.count(F.lit(1)).alias("n_parts"))
    aliases = t.spark.createDataFrame(list(names.MODEL_ALIASES.items()), "alias string, full_name string")
    return R.model_dim(models, aliases, names.MODEL_MEMORY, names.DEFAULT_MEMORY)


# The order priorities stand for models; one keeps its name.
MODEL_IDS = {"1-URGENT": "llama-3.2-1b", "2-HIGH": "qwen-3-4b", "3-MEDIUM": "gpt-4.1-mini", "5-LOW": "o4-mini"}
MODEL_IDS_SQL = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_IDS.items()) + " ELSE model END"
MODEL_NAMES_SQL = """CASE model WHEN 'llama-3.2-1b' THEN 'Llama-3.2 \\textsubscript{(1B)}' WHEN 'qwen-3-4b' THEN 'Qwen-3 \\textsubscript{(4B)}'
      WHEN 'gpt-4.1-mini' THEN 'GPT-4.1-mini & o4-mini' WHEN 'o4-mini' THEN 'GPT-4.1-mini & o4-mini' ELSE model END"""


def model_id(model: Column) -> Column:
    return F.coalesce(*[F.when(model == k, F.lit(v)) for k, v in MODEL_IDS.items()], model)


@query("c13_display", """
    SELECT CASE task WHEN 'grow' THEN 'WIKI' ELSE upper(task) END AS task_name, """ + MODEL_NAMES_SQL + """ AS model_name,
      CASE WHEN model = 'o4-mini' AND method = 'base' THEN 'Append-T' ELSE CASE method WHEN 'original' THEN 'Base Model' WHEN 'base' THEN 'Append' ELSE 'MeLLo' END END AS method_name,
      count(*) AS n FROM (SELECT CASE task WHEN 'MACHINERY' THEN 'grow' ELSE lower(task) END AS task, """ + MODEL_IDS_SQL + """ AS model, method FROM {items}) x
    GROUP BY ALL""")
def c13(t):
    task = F.when(F.col("task") == "MACHINERY", "grow").otherwise(F.lower("task"))
    runs = t.items.select(task.alias("task"), model_id(F.col("model")).alias("model"), "method")
    return R.display_names(runs).groupBy("task_name", "model_name", "method_name").agg(F.count(F.lit(1)).alias("n"))


@query("c14_usage", """
    SELECT flag, p_type, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
      sum(prompt_tokens + completion_tokens)::BIGINT AS total_tokens FROM {responses} GROUP BY ROLLUP (flag, p_type)""")
def c14(t):
    return R.usage_totals(t.responses, ["flag", "p_type"])


BUDGET = 20_000


@query("c15_batches", f"""
    WITH RECURSIVE sorted AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM {{documents}} WHERE n_chars > 0),
    pack AS (SELECT rn, doc_id, n_chars, n_chars AS width, 1::BIGINT AS filled, 0::BIGINT AS batch FROM sorted WHERE rn = 1
      UNION ALL SELECT s.rn, s.doc_id, s.n_chars, CASE WHEN p.width * (p.filled + 1) > {BUDGET} THEN s.n_chars ELSE p.width END,
        CASE WHEN p.width * (p.filled + 1) > {BUDGET} THEN 1 ELSE p.filled + 1 END,
        CASE WHEN p.width * (p.filled + 1) > {BUDGET} THEN p.batch + 1 ELSE p.batch END
      FROM pack p JOIN sorted s ON s.rn = p.rn + 1)
    SELECT doc_id, n_chars, batch FROM pack""")
def c15(t):
    return R.length_batches(t.documents.select("doc_id", "n_chars"), "n_chars", BUDGET, ["doc_id"])


@query("c16_mask", """
    WITH ids AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r]+'), lambda w: length(w)::INT) AS ids FROM {conversations}),
    widths AS (SELECT conv_id, max(len(ids)) AS width FROM ids GROUP BY conv_id)
    SELECT conv_id, count(*) AS n_rows, any_value(width) * count(*) AS padded_cells, sum(len(ids))::BIGINT AS attended,
      coalesce(sum(list_sum(ids)), 0)::BIGINT AS total FROM ids JOIN widths USING (conv_id) GROUP BY conv_id""")
def c16(t):
    ids = t.conversations.select(
        "conv_id", "turn", F.transform(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != ""), lambda w: F.length(w)).alias("ids")
    )
    widths = ids.groupBy("conv_id").agg(F.max(F.size("ids")).alias("width"))
    size, width = F.size("ids"), F.col("width")
    batch = ids.join(widths, "conv_id").select(
        "conv_id", "turn",
        R.pad_to_width(F.col("ids"), width, F.lit(0)).alias("padded"), R.attention_mask(size, width).alias("mask"),
    )
    shape = batch.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("padded")).alias("padded_cells"))
    kept = R.flatten_masked(batch, "padded", "mask", ["conv_id"]).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("attended"), F.sum("value").alias("total")
    )
    return shape.join(kept, "conv_id", "left").fillna(0, ["attended", "total"])


@query("c17_subset", """
    SELECT doc_id, lang, 'pseudorandom' AS kind FROM (SELECT * FROM {documents} ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id LIMIT 100)
    UNION ALL SELECT doc_id, lang, 'first French' FROM (SELECT * FROM {documents} WHERE lang = 'fr' ORDER BY doc_id LIMIT 50)""")
def c17(t):
    drawn = R.subset(t.documents, "doc_id", 100).select("doc_id", "lang", F.lit("pseudorandom").alias("kind"))
    french = R.subset(t.documents, "doc_id", 50, pseudorandom=False, where=F.col("lang") == "fr")
    return drawn.unionByName(french.select("doc_id", "lang", F.lit("first French").alias("kind")))
