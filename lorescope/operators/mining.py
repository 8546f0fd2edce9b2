"""Building items from code and model text: call mining, parsing, filtering, corrections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.functions.pycalls import library_calls
from lorescope.operators.joins import same_keys
from lorescope.functions.text import canonical_call, has_token, strip, strip_backticks

CALL_FIELDS = (
    "seq int, library string, function string, positional_args array<string>,"
    " keyword_args array<struct<name: string, value: string>>, error string"
)
FETCH_FAILED = "<fetch_failed_phase1>"  # fixed value: marks a function without a known signature


def call_rows(code: str | None) -> list[tuple]:
    """Rows of CALL_FIELDS for one code cell; unreadable code gives one error row."""
    try:
        calls = library_calls(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        kind = "SyntaxError" if isinstance(error, SyntaxError) else "ParsingError"
        return [(0, None, None, None, None, kind)]
    return [
        (i, c.library, c.function, c.positional, [{"name": k, "value": v} for k, v in c.keywords], None)
        for i, c in enumerate(calls)
    ]


def api_calls(cells: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Every library call of every code cell, with its arguments as written."""
    names = [key, "seq", "library", "function", "positional_args", "keyword_args", "error"]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, text in zip(batch[key], batch[code]) for row in call_rows(text)]
            yield pd.DataFrame(rows, columns=names)

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, code).mapInPandas(expand, f"{key} {kind}, {CALL_FIELDS}")


def call_catalog(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Each called function once, with its signature or a placeholder."""
    found = calls.filter("function is not null").select("function").distinct().join(signatures, "function", "left")
    missing = F.col("positional_params").isNull()
    return found.select(
        "function",
        F.coalesce("signature_string", F.concat("function", F.lit("(...)"))).alias("signature_string"),
        F.when(missing, F.array(F.lit(FETCH_FAILED))).otherwise(F.col("positional_params")).alias("positional_params"),
        F.when(missing, "N/A (API info fetch failed during discovery phase)").otherwise(F.col("docstring")).alias("docstring"),
    )


def generalize_args(args: Column, params: Column) -> Column:
    """Positional arguments named after the parameters they fill.

    A trailing ``*args`` takes the rest as args_0, args_1, ...; arguments beyond
    the signature become <pos_arg_i>; placeholder parameters keep the argument.
    """
    count = F.size(params)
    last = F.get(params, count - 1)
    starred = F.coalesce(F.startswith(last, F.lit("*")) & ~F.startswith(last, F.lit("**")), F.lit(False))

    def name(arg: Column, i: Column) -> Column:
        param = F.get(params, i)
        kept = F.startswith(param, F.lit("<param")) & F.endswith(param, F.lit("_fallback>"))
        rest = F.concat(F.substr(last, F.lit(2)), F.lit("_"), (i - count + 1).cast("string"))
        return (
            F.when(starred & (i >= count - 1), rest)
            .when(i >= count, F.concat(F.lit("<pos_arg_"), (i + 1).cast("string"), F.lit(">")))
            .when(kept, arg)
            .otherwise(param)
        )

    unknown = params.isNull() | F.array_contains(params, FETCH_FAILED)
    return F.when(unknown, args).otherwise(F.transform(args, name))


def call_knowledge(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls with generalised arguments, documentation and canonical text."""
    joined = calls.filter("function is not null").join(catalog, "function", "left")
    general = joined.withColumn("positional_args", generalize_args(F.col("positional_args"), F.col("positional_params")))
    written = strip(F.col("docstring"))
    doc = F.when((written != "") & (written != "N/A"), F.col("docstring")).otherwise(F.col("signature_string"))
    return general.withColumn("docstring", doc).withColumn(
        "canonical_call", canonical_call(F.col("function"), F.col("positional_args"), F.col("keyword_args"))
    ).drop("positional_params", "signature_string")


def reuse_by_answer(facts: DataFrame, fields: Sequence[str], key: str = "item_id") -> DataFrame:
    """Give every fact the wording the first fact with the same answer got.

    An answer that repeats inside an item stays once, at its first position.
    """
    wording = facts.groupBy("answer").agg(F.min(F.struct(key, "pos", *fields)).alias("_first"))
    once = facts.groupBy(key, "answer").agg(F.min("pos").alias("pos"))
    return same_keys(once, wording, ["answer"], "inner").select(key, "pos", "answer", *[F.col(f"_first.{f}").alias(f) for f in fields])


_KQA = ("Knowledge: ", "\nQuestion: ", "\nAnswer: ", "\nKnowledge:")  # fixed values: the labels of a reply


def kqa_spans(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Where each block's knowledge starts, its question and its answer label stand, and the block ends.

    One scan that never goes back: a block runs from its first label to the next line that starts one once a question
    and then an answer have followed. Until then later lines that start with Knowledge belong to it, and without both
    there is no further block.
    """
    knowledge, question, answer, opening = _KQA
    at = text.find(knowledge)
    while at >= 0:
        begin = at + len(knowledge)
        asked = text.find(question, begin)
        told = text.find(answer, asked + len(question)) if asked >= 0 else -1
        if told < 0:
            return
        end = text.find(opening, told + len(answer))
        yield begin, asked, told, end if end >= 0 else len(text)
        at = text.find(knowledge, end) if end >= 0 else -1


def _kqa_blocks(texts: pa.Array) -> pa.Array:
    """The whole blocks of every text of an Arrow batch, built column by column."""
    knowledge, question, answer, ends = [], [], [], [0]
    for text in texts.to_pylist():
        for begin, asked, told, end in kqa_spans(text or ""):
            block = text[begin:asked].strip(), text[asked + len(_KQA[1]) : told].strip(), text[told + len(_KQA[2]) : end].strip()
            if all(block):
                for column, part in zip((knowledge, question, answer), block):
                    column.append(part)
        ends.append(len(knowledge))
    parts = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (knowledge, question, answer)], ["knowledge", "question", "answer"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


def parse_kqa(rows: DataFrame, text: str) -> DataFrame:
    """Knowledge/Question/Answer blocks of each text, one row per block; blocks that are incomplete or have an empty part are skipped.

    Inside a block the first labels divide it. Texts are scanned once, in Arrow batches.
    """
    keep = [c for c in rows.columns if c != text]
    parts = ("knowledge", "question", "answer")
    scan = F.arrow_udf(_kqa_blocks, "array<struct<knowledge:string,question:string,answer:string>>")
    blocks = rows.select(*keep, F.explode(scan(F.col(text))).alias("_block"))
    return blocks.select(*keep, *[strip(F.col(f"_block.{p}")).alias(p) for p in parts]).filter("knowledge <> '' and question <> '' and answer <> ''")


def parse_json_qa(rows: DataFrame, text: str) -> DataFrame:
    """Question and answer of JSON replies; a reply that is no such object is skipped."""
    parsed = F.from_json(text, "question STRING, answer STRING", {"mode": "PERMISSIVE"})
    return (
        rows.withColumn("_qa", parsed)
        .filter("_qa.question is not null and _qa.answer is not null")
        .select(*[c for c in rows.columns if c != text], "_qa.question", "_qa.answer")
    )


def quality_filter(items: DataFrame, facts: DataFrame, necessity: DataFrame, key: str = "item_id") -> DataFrame:
    """Keep items none of whose facts, nor the necessity check, was answered with No."""
    false_facts = facts.filter(has_token(F.col("verdict"), "No")).select(key)
    unneeded = necessity.filter(has_token(F.col("verdict"), "No")).select(key)
    return items.join(false_facts, key, "left_anti").join(unneeded, key, "left_anti")


def fact_filter(facts: DataFrame) -> DataFrame:
    """Drop only the facts answered with No; an item is gone when none is left."""
    return facts.filter(~F.coalesce(has_token(F.col("verdict"), "No"), F.lit(False)))


def apply_corrections(facts: DataFrame, corrections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace answer and knowledge of facts judged wrong by their corrections.

    Of several corrections of one key the smallest answer, then knowledge, counts, so facts never double.
    """
    fixed = corrections.select(*keys, strip_backticks(F.col("corrected_answer")).alias("_answer"), strip(F.col("corrected_knowledge")).alias("_knowledge"))
    fixed = fixed.groupBy(*keys).agg(F.min(F.struct("_answer", "_knowledge")).alias("_c")).select(*keys, "_c.*")
    wrong = F.coalesce(has_token(F.col("verdict"), "No"), F.lit(False))
    return (
        facts.join(fixed, list(keys), "left")
        .withColumn("corrected", wrong)
        .withColumn("answer", F.when(wrong, F.coalesce("_answer", "answer")).otherwise(F.col("answer")))
        .withColumn("knowledge", F.when(wrong, F.coalesce("_knowledge", "knowledge")).otherwise(F.col("knowledge")))
        .drop("_answer", "_knowledge", "verdict")
    )


def augment_code_question(items: DataFrame, facts: DataFrame, versions: DataFrame, python_version: str, key: str = "item_id") -> DataFrame:
    """Add the functions to use and the library versions to a code question.

    ``facts`` has ``pos``, ``answer`` (a call) and ``library``; a library without
    a known version is not mentioned.
    """
    called = F.concat(F.lit("`"), F.substring_index("answer", "(", 1), F.lit("`"))
    functions = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", called.alias("f")))).alias("_f"))
    pinned = (
        facts.select(key, "library").distinct().join(versions, "library")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.concat("library", F.lit(" ("), "version", F.lit(")")))).alias("_v"))
    )
    listed = F.array_join(F.transform("_f", lambda r: r["f"]), ", ")
    use = F.when(F.col("_f").isNotNull(), F.concat(F.lit("Your code should include these functions: "), listed, F.lit(".")))
    libraries = F.array_join(F.concat(F.array(F.lit(f"Python ({python_version})")), F.coalesce("_v", F.array().cast("array<string>"))), ", ")
    pins = F.concat(F.lit("Ensure your solution is compatible with the following versions: "), libraries, F.lit("."))
    return items.join(functions, key, "left").join(pinned, key, "left").withColumn(
        "question", F.concat_ws("\n\n", "question", use, pins)
    ).drop("_f", "_v")


def augment_math_question(question: Column, plan: Column) -> Column:
    """Add the demand for steps and the plan; end with a full stop."""
    text = F.concat(
        question,
        F.lit(" To solve this problem, you must show detailed step-by-step calculations without skipping any steps."
              " Your solution should focus on "),
        strip(plan),
    )
    return F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
