"""Verdicts kept between runs: each request is judged once, ever.

Verdicts lie in a table of numbered commits (``append_results``). Beside it stands a Bloom filter of the judged keys,
one 64-bit word a row, in which a key sets BITS bits of one word. A new run looks its distinct requests up in the
filter first; only those that may be there meet the table. The filter has no say about a verdict: a false hit costs
a lookup, and commits that it does not cover yet are added before it is used, so that no key is missed.

NULL keys are keys. A run that dies before its commit leaves nothing; of two runs that judge a key at the same time
one verdict is stored, and both return it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescope.operators.joins import same_keys
from lorescope.operators.plugins import Scorer, score
from lorescope.session import cut_lineage
from lorescope.sources.records import append_results, children, committed_folders

BITS = 4  # of its word that a key sets
FILL = 4  # keys a word holds on average before the filter is built anew with twice the words
LEAST = 1024  # words of the smallest filter

_FILTER = "words bigint, keys bigint, word bigint, mask bigint"


def _place(key: Sequence[str], words: Column) -> tuple[Column, Column]:
    """The word of a key and the bits it sets there. The hash passes over NULLs, which can only add false hits."""
    where = F.pmod(F.xxhash64(F.lit(1), *key), words)
    drawn = F.xxhash64(F.lit(2), *key)
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        bit = F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return where, mask


def _filter_of(keys: DataFrame, key: Sequence[str], words: int) -> DataFrame:
    where, mask = _place(key, F.lit(words).cast("bigint"))
    return keys.select(where.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def _stored_filters(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(commits covered, folder) of the complete filters, least first."""
    found = []
    for name in children(spark, f"{path}/_filters"):
        number, _, _ = name.partition("-")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_filters/{name}/_SUCCESS")
        if number.isdigit() and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            found.append((int(number), name))
    return sorted(found)


def key_filter(spark: SparkSession, path: str, key: Sequence[str], folders: Sequence[str]) -> DataFrame:
    """The filter of the keys in ``folders``, the oldest commits of the table: words, keys, word and mask.

    The newest stored filter is taken over and the commits since are added; when it is full, all keys are read again
    for one of twice the words or more, which over time costs as much as the keys once.
    """
    stored = [(n, name) for n, name in _stored_filters(spark, path) if n <= len(folders)]
    covered, old, words, held = 0, None, 0, 0
    if stored:
        covered, name = stored[-1]
        old = spark.read.schema(_FILTER).parquet(f"{path}/_filters/{name}")
        first = old.select("words", "keys").first()
        words, held = (first["words"], first["keys"]) if first else (0, 0)
        if covered == len(folders) and first:
            return old
    since = spark.read.parquet(*[f"{path}/{f}" for f in folders[covered if words else 0 :]]).select(*key)
    held += since.count()
    if held > FILL * words:
        words = LEAST
        while held * 2 > FILL * words:
            words *= 2
        rows = _filter_of(spark.read.parquet(*[f"{path}/{f}" for f in folders]).select(*key), key, words)
    else:
        added = _filter_of(since, key, words)
        rows = old.select("word", "mask").unionByName(added).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    place = f"{path}/_filters/{len(folders):012d}-{uuid.uuid4().hex}"
    rows.select(F.lit(words).cast("bigint").alias("words"), F.lit(held).cast("bigint").alias("keys"), "word", "mask").write.parquet(place)
    return spark.read.schema(_FILTER).parquet(place)


def maybe_known(asked: DataFrame, filter_: DataFrame, key: Sequence[str]) -> DataFrame:
    """``asked`` with ``maybe``: whether the filter has the key. False is certain, true is not."""
    first = filter_.select("words").first()
    if first is None:
        return asked.withColumn("maybe", F.lit(False))
    where, mask = _place(key, F.lit(first["words"]).cast("bigint"))
    held = filter_.select(F.col("word").alias("_word"), F.col("mask").alias("_held"))
    met = asked.withColumns({"_at": where, "_mask": mask}).join(held, F.col("_at") == F.col("_word"), "left")
    inside = F.coalesce(F.col("_held").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    return met.withColumn("maybe", inside).drop("_at", "_mask", "_word", "_held")


def judge_stored(requests: DataFrame, key: Sequence[str], make_scorer: Callable[[], Scorer], schema: str, path: str) -> DataFrame:
    """All rows of ``requests`` with their verdict, judging only keys that no earlier run has stored under ``path``.

    ``key`` are the columns the verdict depends on, ``schema`` what the scorer returns, key included.
    """
    spark = requests.sparkSession
    asked = requests.select(*key).distinct()
    before = committed_folders(spark, path)
    if before:
        marked = cut_lineage(maybe_known(asked, key_filter(spark, path, key, before), key))
        maybe = marked.filter("maybe").drop("maybe")
        stored = spark.read.parquet(*[f"{path}/{f}" for f in before])
        old = cut_lineage(same_keys(stored, maybe, key, "left_semi"))
        asked = marked.filter("not maybe").drop("maybe").unionByName(same_keys(maybe, old.select(*key), key, "left_anti"))
    append_results(score(asked, make_scorer, schema), path, key, seen=before)
    # What another run has stored meanwhile lies in the new commits as well.
    since = committed_folders(spark, path)[len(before) :]
    parts = ([old] if before else []) + ([spark.read.parquet(*[f"{path}/{f}" for f in since])] if since else [])
    replies = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return same_keys(requests, replies, key)
