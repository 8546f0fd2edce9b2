"""Code cells, model replies and verdicts derived from parts, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.functions.text import canonical_call
from lorescope.operators import mining as Q
from lorescope.plans.registry import Inputs, query
from lorescope.plans.text_queries import checksum, sql_checksum
from lorescope.session import shuffle_width

# One code cell per part. Its type decides how the library is imported and called.
_CELLS = """
    SELECT p_partkey AS cell, p_type, CASE p_type
      WHEN 'ECONOMY' THEN concat('import numpy as np', chr(10), 'np.full(', p_size, ', "', p_name, '")')
      WHEN 'LARGE' THEN concat('from pandas import read_csv as rc', chr(10), 'frame = rc("', p_name, '", nrows=', p_size, ')', chr(10), 'frame.head(3)')
      WHEN 'MEDIUM' THEN concat('import os', chr(10), 'import os.path', chr(10), 'os.path.join(os.getcwd(), "', p_brand, '", *rest)')
      WHEN 'PROMO' THEN concat('import json', chr(10), 'json.dumps(', chr(123), '1: ', p_size, chr(125), ', **options)', chr(10), 'print("', p_name, '")')
      WHEN 'SMALL' THEN concat('from math import', chr(10), 'sqrt(', p_size, ')')
      ELSE concat('from datetime import datetime', chr(10), 'datetime.strptime("', p_brand, '", "%Y", ', p_size, ')') END AS code
    FROM {part}"""

# Signatures as a signature table would hold them; os.getcwd has none.
_SIGNATURES = [
    ("numpy.full", "numpy.full(shape, fill_value, dtype=None)", ["shape", "fill_value", "dtype"], "New array of given shape."),
    ("pandas.read_csv", "pandas.read_csv(filepath, sep=',')", ["filepath", "sep"], " "),
    ("os.path.join", "os.path.join(a, *p)", ["a", "*p"], "Join paths."),
    ("json.dumps", "json.dumps(obj)", ["<param0_doc_fallback>"], "Serialize."),
    ("datetime.datetime.strptime", "datetime.datetime.strptime(text, format)", ["text", "format"], "Parse."),
]


def cells(t: Inputs) -> DataFrame:
    """Code cells, dealt to all tasks: a short table of parts is read by few, and parsing its code takes long."""
    return t.spark.sql(_CELLS, part=t.part).repartition(shuffle_width(t.spark))


def calls(t: Inputs) -> DataFrame:
    return Q.api_calls(cells(t), "cell")


def signatures(t: Inputs) -> DataFrame:
    return t.spark.createDataFrame(
        _SIGNATURES, "function string, signature_string string, positional_params array<string>, docstring string"
    )


_CALLS_SQL = """called AS (
      SELECT p_partkey AS cell, 0 AS seq, 'numpy' AS library, 'numpy.full' AS function, concat(p_size, '|''', p_name, '''') AS args, '' AS named, NULL::VARCHAR AS error,
        concat('numpy.full(shape, fill_value)') AS canonical FROM {part} WHERE p_type = 'ECONOMY'
      UNION ALL SELECT p_partkey, 0, 'pandas', 'pandas.read_csv', concat('''', p_name, ''''), concat('nrows=', p_size), NULL, concat('pandas.read_csv(filepath, nrows=', p_size, ')')
        FROM {part} WHERE p_type = 'LARGE'
      UNION ALL SELECT p_partkey, 0, 'os', 'os.path.join', concat('os.getcwd()|''', p_brand, '''|*rest'), '', NULL, 'os.path.join(a, p_0, p_1)' FROM {part} WHERE p_type = 'MEDIUM'
      UNION ALL SELECT p_partkey, 1, 'os', 'os.getcwd', '', '', NULL, 'os.getcwd()' FROM {part} WHERE p_type = 'MEDIUM'
      UNION ALL SELECT p_partkey, 0, 'json', 'json.dumps', concat('{1: ', p_size, '}'), '**options=', NULL, concat('json.dumps({1: ', p_size, '}, **options=)')
        FROM {part} WHERE p_type = 'PROMO'
      UNION ALL SELECT p_partkey, 0, NULL, NULL, NULL, NULL, 'SyntaxError', NULL FROM {part} WHERE p_type = 'SMALL'
      UNION ALL SELECT p_partkey, 0, 'datetime', 'datetime.datetime.strptime', concat('''', p_brand, '''|''%Y''|', p_size), '', NULL, 'datetime.datetime.strptime(text, format, <pos_arg_3>)'
        FROM {part} WHERE p_type = 'STANDARD')"""


def _named(keywords: str):
    return F.array_join(F.transform(keywords, lambda kv: F.concat(kv["name"], F.lit("="), kv["value"])), ",")


@query("b17_api_calls", "WITH " + _CALLS_SQL + " SELECT cell, seq, library, function, args, named, error FROM called")
def b17(t):
    return calls(t).select(
        "cell", "seq", "library", "function", F.array_join("positional_args", "|").alias("args"),
        _named("keyword_args").alias("named"), "error",
    )


@query("b18_catalog", "WITH " + _CALLS_SQL + """
    SELECT DISTINCT function, CASE function WHEN 'numpy.full' THEN 'numpy.full(shape, fill_value, dtype=None)' WHEN 'pandas.read_csv' THEN 'pandas.read_csv(filepath, sep='','')'
      WHEN 'os.path.join' THEN 'os.path.join(a, *p)' WHEN 'json.dumps' THEN 'json.dumps(obj)' WHEN 'os.getcwd' THEN 'os.getcwd(...)'
      ELSE 'datetime.datetime.strptime(text, format)' END AS signature_string, function <> 'os.getcwd' AS known FROM called WHERE function IS NOT NULL""")
def b18(t):
    catalog = Q.call_catalog(calls(t), signatures(t))
    return catalog.select("function", "signature_string", (~F.array_contains("positional_params", Q.FETCH_FAILED)).alias("known"))


@query("b19_generalize", "WITH " + _CALLS_SQL + """
    SELECT cell, seq, function, CASE function WHEN 'numpy.full' THEN 'shape|fill_value' WHEN 'pandas.read_csv' THEN 'filepath' WHEN 'os.path.join' THEN 'a|p_0|p_1'
      WHEN 'datetime.datetime.strptime' THEN 'text|format|<pos_arg_3>' ELSE args END AS args FROM called WHERE function IS NOT NULL""")
def b19(t):
    mined = calls(t)
    known = Q.call_knowledge(mined, Q.call_catalog(mined, signatures(t)))
    return known.select("cell", "seq", "function", F.array_join("positional_args", "|").alias("args"))


@query("b20_render_call", "WITH " + _CALLS_SQL + " SELECT cell, seq, canonical FROM called WHERE function IS NOT NULL")
def b20(t):
    mined = calls(t)
    known = Q.call_knowledge(mined, Q.call_catalog(mined, signatures(t)))
    return known.select("cell", "seq", F.col("canonical_call").alias("canonical"))


@query("b20b_call_text", """
    SELECT l_orderkey AS item_id, l_returnflag AS flag, concat(lower(p_type), '.', replace(p_name, ' ', '_'), '(', p_brand, ', ', p_size, ', tax=', l_linenumber, ')') AS canonical
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""")
def b20b(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    named = F.array(F.struct(F.lit("tax").alias("name"), F.col("l_linenumber").cast("string").alias("value")))
    function = F.concat(F.lower("p_type"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")))
    text = canonical_call(function, F.array("p_brand", F.col("p_size").cast("string")), named)
    return rows.select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("flag"), text.alias("canonical"))


@query("b21_reuse", """
    WITH firsts AS (SELECT knowledge AS answer, probe_answer AS first_wording FROM (SELECT knowledge, probe_answer,
        row_number() OVER (PARTITION BY knowledge ORDER BY item_id, pos) AS rn FROM {facts}) x WHERE rn = 1)
    SELECT item_id, min(pos) AS pos, answer, any_value(first_wording) AS wording FROM {facts} JOIN firsts ON knowledge = answer GROUP BY item_id, answer""")
def b21(t):
    facts = t.facts.select("item_id", "pos", F.col("knowledge").alias("answer"), F.col("probe_answer").alias("wording"))
    return Q.reuse_by_answer(facts, ["wording"])


_REPLY = """
    SELECT l_orderkey AS item_id, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
      concat('Here is what is needed.', chr(10), 'Knowledge: ', p_name, ' is', chr(10), ' of type ', p_type, ' ', chr(10), 'Question: What type is ', p_name, '?', chr(10), 'Answer: ', p_type, chr(10), chr(10),
        'Knowledge: ', p_name, ' has a brand', chr(10), 'Question: ', CASE WHEN l_returnflag = 'R' THEN '' ELSE 'Which brand?' END, chr(10), 'Answer: ', p_brand, '  ') AS reply
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@query("b22_parse_kqa", f"""
    WITH blocks AS (SELECT l_returnflag, concat(p_name, ' is', chr(10), ' of type ', p_type) AS k, concat('What type is ', p_name, '?') AS q, p_type AS a
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
      UNION ALL SELECT l_returnflag, concat(p_name, ' has a brand'), 'Which brand?', p_brand FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_returnflag <> 'R')
    SELECT q AS question, a AS answer, count(*) AS n, {sql_checksum('k')} AS knowledge FROM blocks GROUP BY q, a""")
def b22(t):
    replies = t.spark.sql(_REPLY, lineitem=t.lineitem, part=t.part)
    blocks = Q.parse_kqa(replies.select("item_id", "reply"), "reply")
    return blocks.groupBy("question", "answer").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.col("knowledge")).alias("knowledge")
    )


@query("b23_parse_json", """
    SELECT event_id, event_type, concat('k of user ', user_id, '?') AS question, (props::JSON->>'$.k') AS answer FROM {events} WHERE event_type NOT IN ('error', 'view')""")
def b23(t):
    good = F.concat(
        F.lit('{"question": "k of user '), F.col("user_id").cast("string"), F.lit('?", "answer": "'),
        F.get_json_object("props", "$.k"), F.lit('"}'),
    )
    # Errors come back cut off, views without the expected fields.
    reply = F.when(F.col("event_type") == "error", F.substr(good, F.lit(1), F.lit(20))).when(F.col("event_type") == "view", F.col("props")).otherwise(good)
    return Q.parse_json_qa(t.events.select("event_id", "event_type", reply.alias("reply")), "reply")


_NO = r"regexp_matches({c}, '(^|[\s\p{{Z}}])No([\s\p{{Z}}]|$)')"


def necessity(t: Inputs) -> DataFrame:
    text = F.when(F.col("gt_answer") == "P", "No it is not needed").otherwise("Yes, No doubt is left")
    text = F.when(F.col("gt_answer") == "F", "Yes, needed").otherwise(text)
    return t.items.select("item_id", text.alias("verdict"))


@query("b24_quality", f"""
    WITH bad AS (SELECT DISTINCT item_id FROM {{responses}} WHERE {_NO.format(c='quality_text')}),
    left_over AS (SELECT item_id, count(*) AS n FROM {{responses}} WHERE NOT {_NO.format(c='quality_text')} GROUP BY item_id)
    SELECT task, count(*) AS n_items, count(*) FILTER (WHERE gt_answer = 'F' AND item_id NOT IN (SELECT item_id FROM bad)) AS kept,
      count(n) AS kept_by_fact, coalesce(sum(n), 0)::BIGINT AS facts_left
    FROM {{items}} LEFT JOIN left_over USING (item_id) GROUP BY task""")
def b24(t):
    items = t.items.select("item_id", "task")
    facts = t.responses.select("item_id", F.col("quality_text").alias("verdict"))
    strict = Q.quality_filter(items, facts, necessity(t)).select("item_id", F.lit(True).alias("_kept"))
    loose = Q.fact_filter(facts).groupBy("item_id").agg(F.count(F.lit(1)).alias("_left"))
    return items.join(strict, "item_id", "left").join(loose, "item_id", "left").groupBy("task").agg(
        F.count(F.lit(1)).alias("n_items"), F.count("_kept").alias("kept"),
        F.count("_left").alias("kept_by_fact"), F.coalesce(F.sum("_left"), F.lit(0)).alias("facts_left"),
    )


@query("b25_corrections", f"""
    SELECT flag, wrong AS corrected, count(*) AS n, {sql_checksum("CASE WHEN wrong THEN concat(p_type, '()') ELSE p_brand END")} AS answers,
      {sql_checksum("CASE WHEN wrong THEN concat('Use ', p_type) ELSE p_name END")} AS knowledge
    FROM (SELECT *, {_NO.format(c='quality_text')} AS wrong FROM {{responses}}) x GROUP BY flag, wrong""")
def b25(t):
    keyed = t.responses.withColumn("fact_id", F.xxhash64("item_id", "line_no", "part_key"))
    base = keyed.select("fact_id", "flag", F.col("p_brand").alias("answer"), F.col("p_name").alias("knowledge"), F.col("quality_text").alias("verdict"))
    corrections = keyed.select(
        "fact_id",
        F.concat(F.lit(" `python "), "p_type", F.lit("()` ")).alias("corrected_answer"),
        F.concat(F.lit(" Use "), "p_type", F.lit(" ")).alias("corrected_knowledge"),
    ).dropDuplicates(["fact_id"])
    fixed = Q.apply_corrections(base, corrections, ["fact_id"])
    return fixed.groupBy("flag", "corrected").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.col("answer")).alias("answers"), checksum(F.col("knowledge")).alias("knowledge")
    )


@query("b26_augment", """
    WITH versions AS (SELECT p_brand AS library, concat('1.', max(p_size)) AS version FROM {part} GROUP BY p_brand HAVING max(p_size) < 50),
    used AS (SELECT item_id, string_agg(concat('`', knowledge, '`'), ', ' ORDER BY pos) AS f FROM {facts} GROUP BY item_id),
    pins AS (SELECT item_id, string_agg(concat(library, ' (', version, ')'), ', ' ORDER BY concat(library, ' (', version, ')')) AS v
      FROM (SELECT DISTINCT item_id, probe_answer AS library FROM {facts}) x JOIN versions USING (library) GROUP BY item_id)
    SELECT item_id, concat_ws(chr(10) || chr(10), question, CASE WHEN f IS NOT NULL THEN concat('Your code should include these functions: ', f, '.') END,
      concat('Ensure your solution is compatible with the following versions: Python (3.13)', CASE WHEN v IS NULL THEN '' ELSE concat(', ', v) END, '.')) AS code_question,
      question || ' To solve this problem, you must show detailed step-by-step calculations without skipping any steps. Your solution should focus on ' || model || '.' AS math_question
    FROM {items} LEFT JOIN used USING (item_id) LEFT JOIN pins USING (item_id)""")
def b26(t):
    brands = t.part.groupBy(F.col("p_brand").alias("library")).agg(F.max("p_size").alias("_s")).filter("_s < 50")
    versions = brands.select("library", F.concat(F.lit("1."), F.col("_s").cast("string")).alias("version"))
    facts = t.facts.select("item_id", "pos", F.concat("knowledge", F.lit("(x)")).alias("answer"), F.col("probe_answer").alias("library"))
    items = t.items.select("item_id", "question", "model")
    math = Q.augment_math_question(F.col("question"), F.concat(F.lit(" "), "model", F.lit(" ")))
    out = Q.augment_code_question(items.withColumn("math_question", math), facts, versions, "3.13")
    return out.select("item_id", F.col("question").alias("code_question"), "math_question")
