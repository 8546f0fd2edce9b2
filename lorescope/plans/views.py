"""Derived inputs over the shared tables, as SQL both engines run.

Each view is one SELECT with ``{name}`` for the tables and views it reads. In
Spark the names bind to DataFrames; in the twin SQL they become CTEs. Only
``facts`` differs: positions inside an item come from a window in the twin SQL
and from a range-partitioned ordering in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lorescope.operators.ordering import position_in_group
from lorescope.sources.tables import TABLES, table

# Line order inside an item: the line number repeats, so every column takes part.
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)

_FENCE = "concat(chr(96), chr(96), chr(96))"

VIEWS: dict[str, str] = {
    "items": """
        SELECT o_orderkey AS item_id, c_mktsegment AS task, o_orderpriority AS model,
          CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'original' WHEN 1 THEN 'base' ELSE 'mello' END AS method,
          CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 500 END AS scope,
          CASE WHEN c_acctbal >= 0 THEN concat('Which status has order ', CAST(o_orderkey AS STRING), ' of ', c_name, '?') END AS question,
          o_orderstatus AS gt_answer, o_orderstatus = 'F' AS final_answer_correct,
          year(o_orderdate) < 1999 AS done
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "lines": """
        SELECT l_orderkey AS item_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
          l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
          p_name AS knowledge, l_linestatus = 'O' AS knowledgable, l_discount AS knowledge_confidence,
          CASE WHEN l_discount <= 0.08 THEN 'entailment' WHEN l_discount <= 0.09 THEN 'contradiction' ELSE 'neutral' END AS nli_class,
          CASE WHEN p_size > 1 THEN concat('What is the brand of ', p_name, '?') END AS probe_question,
          p_brand AS probe_answer
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "classes": """
        SELECT l_orderkey AS item_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
          l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linestatus = 'O' AS knowledgable,
          CASE WHEN l_discount <= 0.08 THEN 'entailment' WHEN l_discount <= 0.09 THEN 'contradiction' ELSE 'neutral' END AS nli_class
        FROM {lineitem}""",
    "facts": f"""
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY {", ".join(LINE_ORDER)}) - 1 AS pos,
          knowledge, knowledgable, knowledge_confidence, nli_class, probe_question, probe_answer
        FROM {{lines}}""",
    "scored": """
        SELECT i.item_id, task, model, method, scope, coalesce(final_answer_correct, false) AS ap, coalesce(all_entailed, true) AS fke,
          coalesce(final_answer_correct, false) AND coalesce(all_entailed, true) AS hp
        FROM {items} i LEFT JOIN (SELECT item_id, bool_and(coalesce(nli_class = 'entailment', false)) AS all_entailed
          FROM {classes} GROUP BY item_id) f ON i.item_id = f.item_id""",
    "votes": """
        SELECT l_orderkey AS probe_id, l_linestatus AS answer, o_orderstatus AS gt_answer,
          CASE WHEN l_linestatus = o_orderstatus THEN 'Equivalence: Yes, the same.' ELSE 'Equivalence: No, they differ.' END AS verdict_text
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "raters": """
        SELECT l.doc_id AS idx, lang AS domain, source AS task,
          CASE WHEN n_chars < 40 THEN -1 ELSE quality END AS label_1, toxic AS label_2
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "triples": """
        SELECT concat('O', CAST(o_orderkey AS STRING)) AS subj, 'placed_by' AS prop, concat('C', CAST(o_custkey AS STRING)) AS obj, 1 AS prop_rank FROM {orders}
        UNION ALL SELECT concat('O', CAST(l_orderkey AS STRING)), 'contains', concat('P', CAST(l_partkey AS STRING)), 2 FROM {lineitem}
        UNION ALL SELECT concat('C', CAST(c_custkey AS STRING)), 'lives_in', concat('N', CAST(c_nationkey AS STRING)), 1 FROM {customer}
        UNION ALL SELECT concat('C', CAST(o_custkey AS STRING)), 'first_order', concat('O', CAST(min(o_orderkey) AS STRING)), 2 FROM {orders} GROUP BY o_custkey
        UNION ALL SELECT concat('N', CAST(c_nationkey AS STRING)), 'top_customer', concat('C', CAST(min(c_custkey) AS STRING)), 1
          FROM {customer} JOIN (SELECT c_nationkey AS nk, max(c_acctbal) AS best FROM {customer} GROUP BY c_nationkey) t
            ON c_nationkey = nk AND c_acctbal = best GROUP BY c_nationkey
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), 'part_of', concat('R', CAST(n_regionkey AS STRING)), 2 FROM {nation}
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), 'based_in', concat('N', CAST(s_nationkey AS STRING)), 1 FROM {supplier}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), 'has_brand', concat('B', p_brand), 1 FROM {part}""",
    "entity_labels": """
        SELECT concat('C', CAST(c_custkey AS STRING)) AS id, c_name AS label FROM {customer}
        UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name FROM {nation}
        UNION ALL SELECT concat('R', CAST(r_regionkey AS STRING)), r_name FROM {region}
        UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name FROM {supplier}
        UNION ALL SELECT concat('P', CAST(p_partkey AS STRING)), p_name FROM {part}
        UNION ALL SELECT concat('O', CAST(o_orderkey AS STRING)), concat('Order ', CAST(o_orderkey AS STRING)) FROM {orders}""",
    "prop_labels": """
        SELECT * FROM (VALUES ('placed_by', 'buyer'), ('contains', 'part'), ('lives_in', 'nation'),
          ('first_order', 'first order'), ('top_customer', 'top customer'), ('part_of', 'region'),
          ('based_in', 'seat'), ('has_brand', 'brand')) AS t(prop, prop_label)""",
    "instance_of": """
        SELECT id AS subj, CASE substr(id, 1, 1) WHEN 'C' THEN 'customer' WHEN 'N' THEN 'nation' WHEN 'R' THEN 'region'
          WHEN 'S' THEN 'supplier' WHEN 'P' THEN 'product' ELSE 'order' END AS class FROM {entity_labels}""",
    "subclass_of": """
        SELECT * FROM (VALUES ('customer','party'), ('supplier','party'), ('party','agent'), ('agent','entity'),
          ('nation','place'), ('region','place'), ('place','entity'), ('product','thing'), ('thing','entity')) AS t(sub, sup)""",
    "templates": """
        SELECT * FROM (VALUES
          ('placed_by', 'Who placed [S]?', '[S] was placed by ___.', 'the buyer of [S]'),
          ('contains', 'What does [S] contain?', '[S] contains ___.', 'the part in [S]'),
          ('lives_in', 'Where does [S] live?', '[S] lives in ___.', 'the nation of [S]'),
          ('first_order', 'What was the first order of [S]?', 'The first order of [S] is ___.', 'the first order of [S]'),
          ('top_customer', 'Who is the top customer in [S]?', 'The top customer in [S] is ___.', 'the top customer in [S]'),
          ('part_of', 'What is [S] part of?', '[S] is part of ___.', 'the region of [S]'),
          ('based_in', 'Where is [S] based?', '[S] is based in ___.', 'the seat of [S]'),
          ('has_brand', 'Which brand does [S] have?', 'The brand of [S] is ___.', 'the brand of [S]')
        ) AS t(prop, question, cloze, attributive)""",
    "responses": f"""
        SELECT l_orderkey AS item_id, l_linenumber AS line_no, l_partkey AS part_key, l_linestatus AS answer, p_name, p_brand, p_type,
          l_returnflag AS flag,
          concat('Assistant: 1. ', p_name, chr(10),
            CASE WHEN l_returnflag = 'A' THEN concat({_FENCE}, 'python', chr(10), p_type, '(', p_brand, ')', chr(10), {_FENCE}, chr(10)) ELSE '' END,
            '2. The answer is ', l_linestatus, chr(10), '  ', chr(10)) AS model_response,
          concat(CASE l_returnflag WHEN 'A' THEN 'Equivalence: Yes, ' WHEN 'R' THEN 'I would say yes: ' ELSE 'No. It is not ' END, p_name) AS verdict_text,
          concat(CASE WHEN l_returnflag = 'N' AND l_tax > 0.06 THEN 'Checked: No because of ' WHEN l_returnflag = 'N' THEN 'No, ' ELSE 'Yes ' END, p_name) AS quality_text,
          CASE WHEN l_discount <= 0.06 THEN 'NLI: Entailment. ' WHEN l_discount <= 0.08 THEN 'This is not entailment.'
               WHEN l_discount <= 0.09 THEN 'Contradiction: differs.' ELSE 'Cannot tell.' END AS nli_text,
          CAST(l_quantity AS BIGINT) AS prompt_tokens, CAST(l_quantity + l_linenumber AS BIGINT) AS completion_tokens
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
}

_REF = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table or a derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, folder, name)
    if name == "facts":
        lines = view(spark, folder, "lines")
        keep = ["knowledge", "knowledgable", "knowledge_confidence", "nli_class", "probe_question", "probe_answer"]
        return position_in_group(lines, ["item_id"], list(LINE_ORDER)).select("item_id", "pos", *keep)
    text = VIEWS[name]
    return spark.sql(text, **{ref: view(spark, folder, ref) for ref in dict.fromkeys(_REF.findall(text))})


def twin(sql: str) -> str:
    """DuckDB statement for ``sql``: every ``{view}`` it needs becomes a CTE."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in _REF.findall(text):
            if ref in VIEWS and ref not in needed:
                visit(VIEWS[ref])
                needed.append(ref)

    visit(sql)
    body = _REF.sub(r"\1", sql).strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({_REF.sub(r'\1', VIEWS[name]).strip()})" for name in needed)
    recursive = "RECURSIVE " if re.search(r"^WITH RECURSIVE\b", body) else ""
    body = re.sub(r"^WITH (RECURSIVE )?", ",\n", body) if body.startswith("WITH") else "\n" + body
    return f"WITH {recursive}{ctes}{body}"
