"""Readers and resumable writers for items, runs, annotations and statistics."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorescope.operators.joins import same_keys

FACT = "knowledge STRING, knowledgable BOOLEAN, knowledge_confidence DOUBLE"
REASONING_ITEM = f"item_id BIGINT, question STRING, answer STRING, required_knowledge ARRAY<STRUCT<{FACT}>>"
RAW_ITEM = (
    "item_id BIGINT, multihop_question STRING, multihop_answer STRING,"
    " probe_questions ARRAY<STRUCT<question STRING, answer STRING, knowledge STRING>>"
)
ANNOTATION = "MAP<STRING, MAP<STRING, MAP<STRING, ARRAY<INT>>>>"


BROKEN = "_broken"


def read_items(spark: SparkSession, path: str, schema: str = RAW_ITEM, fmt: str = "json") -> DataFrame:
    """Nested items under a fixed schema.

    A JSON record that is no item stays, with its text in the column ``_broken``
    and all else NULL, so that it can be counted; ``sound_items`` leaves it out.
    """
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path).withColumn(BROKEN, F.lit(None).cast("string"))
    reader = spark.read.schema(f"{schema}, {BROKEN} STRING").option("columnNameOfCorruptRecord", BROKEN)
    return reader.option("mode", "PERMISSIVE").json(path)


def sound_items(items: DataFrame) -> DataFrame:
    """The records that were items."""
    return items.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def write_runs(runs: DataFrame, path: str, dims: Sequence[str]) -> None:
    """Result sets as one partition per run key.

    Adaptive execution deals rows into tasks by size, so that a run that holds
    most rows is written by many.
    """
    runs.hint("rebalance", *[F.col(d) for d in dims]).write.partitionBy(*dims).mode("append").parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    place, store = _files(spark, path)
    return [f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()] if store.exists(place) else []


def _is_wanted(stored: str, values: Sequence) -> bool:
    def number(text: str) -> float | None:
        try:
            return float(text)
        except ValueError:
            return None

    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values if v is not None]
    return stored in texts or (number(stored) is not None and number(stored) in [number(t) for t in texts])


def run_folders(spark: SparkSession, path: str, where: Mapping[str, Sequence]) -> list[str]:
    """The folders of the wanted run keys, found from the top: a folder that is not wanted is never listed.

    Once the last dimension asked for is met, what lies below is left to the reader.
    """
    open_, found = [(path.rstrip("/"), frozenset(where))], []
    while open_:
        folder, asked = open_.pop()
        if not asked:
            found.append(folder)
            continue
        for name in children(spark, folder):
            dim, equals, value = name.partition("=")
            if equals and (dim not in where or _is_wanted(unquote(value), where[dim])):
                open_.append((f"{folder}/{name}", asked - {dim}))
    return sorted(found)


def read_runs(
    spark: SparkSession, path: str, where: Mapping[str, Sequence] | None = None, schema: StructType | None = None
) -> DataFrame:
    """Result sets of the wanted run keys; only their folders are listed and read, and missing ones give no rows.

    ``schema`` has all columns, dimensions included; without it that of the files found is taken, or of any file of
    the table where none of the wanted ones is there, and the kind of a dimension follows from the values found.
    NULL is no run key.
    """
    reader = spark.read.option("basePath", path).option("ignoreMissingFiles", "true")
    reader = reader.schema(schema) if schema is not None else reader
    if where is None:
        return reader.parquet(path)
    folders = run_folders(spark, path, where)
    if not folders:
        known = spark.read.parquet(path).schema if schema is None else schema
        return spark.createDataFrame([], known)
    runs = reader.parquet(*map(_literal, folders))
    for dim, values in where.items():
        runs = runs.filter(F.col(dim).isin([v for v in values if v is not None]))
    return runs


def _literal(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)  # readers take these for patterns


_RUN_FILE = r"([^/]+)/[^/]+/([^/]+)_(\d+)_([^/_]+)_(\d+)\.\w+$"


def run_key(rows: DataFrame, path: str) -> DataFrame:
    """Task, method, data size, model and scope from ``task/stage/method_size_model_scope.ext``; NULL for other names."""

    def part(group: int, kind: str) -> Column:
        found = F.regexp_extract(path, _RUN_FILE, group)
        return F.when(found != "", found).cast(kind)

    return rows.withColumns({
        "task": part(1, "string"), "method": part(2, "string"), "data_size": part(3, "int"),
        "model": part(4, "string"), "scope": part(5, "int"),
    })


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """{model: {domain: {task: [label]}}} documents, one per line, as long rows.

    A list cut over several documents carries the index of its first label in
    ``start``; without it a list starts at 0.
    """
    lines = spark.read.text(path)
    nested = lines.select(
        F.coalesce(F.get_json_object("value", "$.start").cast("int"), F.lit(0)).alias("start"),
        F.from_json(F.coalesce(F.get_json_object("value", "$.labels"), "value"), ANNOTATION).alias("m"),
    )
    return (
        nested.select("start", F.explode("m").alias("model", "m"))
        .select("start", "model", F.explode("m").alias("domain", "m"))
        .select("start", "model", "domain", F.explode("m").alias("task", "labels"))
        .select("model", "domain", "task", "start", F.posexplode("labels").alias("pos", "label"))
        .select("model", "domain", "task", (F.col("start") + F.col("pos")).alias("idx"), "label")
    )


def write_annotations(labels: DataFrame, path: str, chunk: int = 10_000) -> None:
    """Long labels as annotation documents of at most ``chunk`` labels each."""
    rows = labels.groupBy("model", "domain", "task", F.floor(F.col("idx") / chunk).alias("_c")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "label"))).alias("_l")
    )
    values = F.transform("_l", lambda r: r["label"])
    nested = F.create_map("model", F.create_map("domain", F.create_map("task", values)))
    rows.select(
        F.to_json(F.struct((F.col("_c") * chunk).cast("int").alias("start"), nested.alias("labels")))
    ).write.text(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Make ``folder`` commit ``number`` of the table, unless another writer has that number: a rename that may not
    replace a file, as the store's own file contexts do it."""
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    staged, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_claims/{folder}", f"_commits/{number:012d}"))
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    kept = spark.sparkContext._gateway.new_array(rename, 1)
    kept[0] = rename.NONE
    place, store = _files(spark, f"{path}/_claims/{folder}")
    store.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{path}/_commits"))
    out = store.create(place, False)
    out.write(folder.encode())
    out.close()
    try:
        files.rename(staged, final, kept)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()) or store.exists(final):
            store.delete(place, False)
            return False
        raise
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows of a results table, None before the first commit. What a failed writer left is not read."""
    folders = committed_folders(spark, path)
    return spark.read.parquet(*[f"{path}/{f}" for f in folders]) if folders else None


def append_results(results: DataFrame, path: str, key: Sequence[str], seen: Sequence[str] = ()) -> DataFrame:
    """Append the rows whose key is not stored yet, and return the stored table.

    Rows are staged in a folder of their own and count once a numbered commit names it. A rerun adds only what is
    missing, whatever the gaps; a writer that dies before its commit leaves nothing that is read; of two writers that
    want a number the later one drops what the other has stored meanwhile and takes the next. NULL keys are keys.
    ``seen`` are committed folders none of whose keys is in ``results``, so they need no comparison.
    """
    spark = results.sparkSession
    rows = results
    while True:
        known = committed_folders(spark, path)
        added = [f for f in known if f not in seen]
        if added:
            rows = same_keys(rows, spark.read.parquet(*[f"{path}/{f}" for f in added]).select(*key).distinct(), key, "left_anti")
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        staged = spark.read.schema(results.schema).parquet(f"{path}/{folder}")
        if known and staged.isEmpty():
            break
        if _claim(spark, path, len(known), folder):
            break
        seen, rows = known, staged  # only what was committed since has to be compared
    return read_results(spark, path)


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """Committed folders, oldest first."""
    place, store = _files(spark, f"{path}/_commits")
    if not store.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in store.listStatus(place))
    listed = spark.read.text([f"{path}/_commits/{n}" for n in names if n.isdigit()]) if any(n.isdigit() for n in names) else None
    return [] if listed is None else [r["value"] for r in listed.orderBy(F.col("_metadata.file_name")).collect()]


def drop_uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that no commit names, and return them; for tables without a writer at work."""
    place, store = _files(spark, path)
    kept = set(committed_folders(spark, path))
    lost = [n for n in (f.getPath().getName() for f in store.listStatus(place)) if n.startswith("rows-") and n not in kept]
    for name in lost:
        store.delete(_files(spark, f"{path}/{name}")[0], True)
    return sorted(lost)


def patch_missing(
    full: DataFrame, partial: DataFrame, key: Sequence[str], recompute, order: Sequence[str | Column] = ()
) -> DataFrame:
    """Partial results with the missing rows recomputed from the full input, gaps anywhere.

    NULL keys are keys. With ``order``, columns of the result, rows come back sorted by it, the
    order of the input when those name it.
    """
    missing = same_keys(full, partial.select(*key).distinct(), key, "left_anti")
    patched = partial.unionByName(recompute(missing))
    return patched.orderBy(*order) if order else patched


def save_stat(state: DataFrame, path: str, args: Mapping[str, str]) -> None:
    """Store a statistic's state rows together with the arguments they were computed under."""
    stored = F.create_map(*[F.lit(str(x)) for pair in sorted(args.items()) for x in pair])
    state.withColumn("args", stored).write.mode("append").parquet(path)


def load_stat(spark: SparkSession, path: str, args: Mapping[str, str]) -> DataFrame | None:
    """State rows stored under the same arguments, or None."""
    states = _existing(spark, path)
    if states is None:
        return None
    same: Column = F.size("args") == len(args)
    for name, value in args.items():
        same = same & (F.col("args")[name] == str(value))
    state = states.filter(same).drop("args")
    return state if state.take(1) else None
