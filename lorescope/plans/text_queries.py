"""Response and verdict parsing, applied to whole response tables and summarised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorescope.functions import text as X
from lorescope.functions.hashing import hash32
from lorescope.operators.reshape import qa_history
from lorescope.plans.registry import query

# The same characters as text.WHITESPACE, quoted for SQL.
_CHARS = "'" + X.WHITESPACE + "'"
_CLASS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_NOT = r"[^\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def sql_strip(text: str) -> str:
    return f"trim({text}, {_CHARS})"


def checksum(text: Column) -> Column:
    return F.sum(hash32(F.coalesce(text, F.lit("(null)"))))


def sql_checksum(text: str) -> str:
    return f"sum(('0x' || substr(md5(coalesce({text}, '(null)')), 1, 8))::BIGINT)::BIGINT"


@query("d1_clean", f"""
    SELECT flag, count(*) AS n, sum(length(clean))::BIGINT AS chars, {sql_checksum('clean')} AS digest
    FROM (SELECT flag, {sql_strip("replace(model_response, 'Assistant:', '')")} AS clean FROM {{responses}}) x GROUP BY flag""")
def d1(t):
    clean = X.clean_response(F.col("model_response"))
    return t.responses.select("flag", clean.alias("clean")).groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("clean")).alias("chars"), checksum(F.col("clean")).alias("digest")
    )


_CODE_SQL = r"regexp_extract(model_response, '```python\s*([\s\S]*?)\s*```', 1)"
_HAS_CODE = r"regexp_matches(model_response, '```python\s*([\s\S]*?)\s*```')"


@query("d2_code_block", f"""
    SELECT flag, count(*) AS n, count(*) FILTER (WHERE answer_code <> 'N/A') AS with_code, {sql_checksum('probe_code')} AS probe_digest,
      {sql_checksum('answer_code')} AS answer_digest
    FROM (SELECT flag, CASE WHEN {_HAS_CODE} THEN {sql_strip(_CODE_SQL)} ELSE {sql_strip('model_response')} END AS probe_code,
      CASE WHEN {_HAS_CODE} THEN {sql_strip(_CODE_SQL)} ELSE 'N/A' END AS answer_code FROM {{responses}}) x GROUP BY flag""")
def d2(t):
    raw = F.col("model_response")
    parsed = t.responses.select(
        "flag", X.code_block(raw).alias("probe_code"), X.code_block(raw, "answer").alias("answer_code")
    )
    return parsed.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("answer_code") != "N/A").alias("with_code"),
        checksum(F.col("probe_code")).alias("probe_digest"),
        checksum(F.col("answer_code")).alias("answer_digest"),
    )


@query("d3_final_line", f"""
    SELECT final_line, count(*) AS n, count(*) FILTER (WHERE final_line = '2. The answer is ' || answer) AS matched FROM (
      SELECT answer, coalesce(list_last(list_filter(list_transform(string_split(model_response, chr(10)), lambda s: {sql_strip('s')}),
        lambda s: s <> '')), '') AS final_line FROM {{responses}}) x GROUP BY final_line""")
def d3(t):
    line = X.final_line(F.col("model_response"))
    return t.responses.select("answer", line.alias("final_line")).groupBy("final_line").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("final_line") == F.concat(F.lit("2. The answer is "), "answer")).alias("matched"),
    )


@query("d3b_document_last_line", f"""
    SELECT doc_id, coalesce(list_last(list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')), '')
      AS final_line FROM {{documents}}""")
def d3b(t):
    return t.documents.select("doc_id", X.final_line(F.col("text")).alias("final_line"))


@query("d4_verdict", f"""
    SELECT flag, count(*) AS n, count(*) FILTER (WHERE starts_with(lower({sql_strip("replace(replace(verdict_text, 'Equivalence:', ''), 'Correct:', '')")}), 'yes')) AS by_prefix,
      count(*) FILTER (WHERE contains(lower(replace(verdict_text, 'Equivalence:', '')), 'yes')) AS by_contains,
      sum(contains(lower(verdict_text), 'yes')::INT)::BIGINT AS labels FROM {{responses}} GROUP BY flag""")
def d4(t):
    raw = F.col("verdict_text")
    return t.responses.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(X.verdict(raw, "prefix")).alias("by_prefix"),
        F.count_if(X.verdict(raw, "contains")).alias("by_contains"),
        F.sum(X.binary_label(raw)).alias("labels"),
    )


@query("d5_nli", """
    SELECT flag, CASE WHEN contains(lower(nli_text), 'entailment') THEN 'entailment' WHEN contains(lower(nli_text), 'contradiction')
      THEN 'contradiction' ELSE 'neutral' END AS nli_class, count(*) AS n FROM {responses} GROUP BY ALL""")
def d5(t):
    return t.responses.groupBy("flag", X.nli_class(F.col("nli_text")).alias("nli_class")).agg(F.count(F.lit(1)).alias("n"))


@query("d6_token", f"""
    SELECT flag, count(*) AS n, count(*) FILTER (WHERE regexp_matches(quality_text, '(^|{_CLASS})No({_CLASS}|$)')) AS says_no
    FROM {{responses}} GROUP BY flag""")
def d6(t):
    return t.responses.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(X.has_token(F.col("quality_text"), "No")).alias("says_no")
    )


_TURNS = """SELECT conv_id, turn, role, CASE role WHEN 'user' THEN concat('[Thought] keep going', chr(10), '[Next Subquestion]  ', text)
    WHEN 'system' THEN text ELSE concat(replace(text, chr(10), ' '), '?') END AS reply FROM {conversations}"""


@query("d8_subq", f"""
    SELECT conv_id, turn, CASE WHEN contains(bare, '[Next Subquestion]')
        THEN string_split({sql_strip("regexp_extract(bare, '(?s)\\[Next Subquestion\\]\\s*(.*)', 1)")}, chr(10))[1]
      WHEN contains(bare, '?') AND NOT contains(bare, chr(10)) THEN bare END AS subquestion
    FROM (SELECT conv_id, turn, {sql_strip('reply')} AS bare FROM ({_TURNS}) y) x""")
def d8(t):
    turns = t.spark.sql(_TURNS, conversations=t.conversations)
    return turns.select("conv_id", "turn", X.next_subquestion(F.col("reply")).alias("subquestion"))


@query("d9_think", f"""
    SELECT doc_id, {sql_strip("list_last(string_split(reply, '</think>'))")} AS answer FROM (
      SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'fr' THEN concat('plan</think>again</think>', text)
        ELSE concat('plan </think> ', text) END AS reply FROM {{documents}}) x""")
def d9(t):
    reply = (
        F.when(F.col("lang") == "en", F.col("text"))
        .when(F.col("lang") == "fr", F.concat(F.lit("plan</think>again</think>"), "text"))
        .otherwise(F.concat(F.lit("plan </think> "), "text"))
    )
    return t.documents.select("doc_id", X.after_think(reply).alias("answer"))


@query("d10_history", f"""
    WITH asked AS (SELECT conv_id, turn, text FROM {{conversations}} WHERE role = 'user'),
    answered AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM {{conversations}} WHERE role = 'assistant'),
    ranked AS (SELECT conv_id, turn, concat('Subquestion: ', text, chr(10), 'Generated Answer: ', answer, chr(10)) AS step,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS step_no FROM asked JOIN answered USING (conv_id, turn))
    SELECT conv_id, step_no, {sql_strip("string_agg(step, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")} AS history
    FROM ranked WHERE step_no <= 6""")
def d10(t):
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = t.conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return qa_history(asked.join(answered, ["conv_id", "turn"]), "conv_id", "turn", max_steps=6)


@query("d11_concepts", f"""
    SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda s: {sql_strip('s')}), lambda s: s <> '')) AS n_concepts,
      ('0x' || substr(md5(array_to_string(list_filter(list_transform(string_split(text, ','), lambda s: {sql_strip('s')}), lambda s: s <> ''), '|')), 1, 8))::BIGINT AS digest
    FROM {{documents}}""")
def d11(t):
    concepts = t.documents.select("doc_id", X.split_concepts(F.col("text")).alias("concepts"))
    return concepts.select(
        "doc_id", F.size("concepts").cast("bigint").alias("n_concepts"),
        hash32(F.array_join("concepts", "|")).alias("digest"),
    )


@query("d12_tokens", f"""
    SELECT source, lang, count(*) AS n, sum(len(regexp_extract_all(text, '{_NOT}+')))::BIGINT AS words FROM {{documents}} GROUP BY source, lang""")
def d12(t):
    return t.documents.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.word_count(F.col("text"))).alias("words")
    )
