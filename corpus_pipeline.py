"""From raw documents to token ids: five stages, each on all that the one before kept.

All stages but the last return the columns they got, extra ones included and whatever their names; an empty table
stays empty; repeated rows are judged each, until the third stage leaves one row of an id.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorescope.llm import language, mixing, neardup, pieces, quality
from lorescope.llm.common import small_batches
from lorescope.session import cut_lineage

SURE = 0.4  # least share of the likelihood that the best language must have
FEW = 32  # code points below which a text says too little to be dropped for its score


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A NULL text is judged as an empty one; rows with a NULL id are judged too; without labels all stay.
    """
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~quality.held_out())
    return quality.keep_good(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the table, not undecided between several unless they are too short to tell.

    NULL texts and texts without a letter go; a NULL ``lang`` is never learned from; without any language all go.
    """
    small_batches(spark)
    return language.keep_known(docs, language.fit(docs, learn=~language.held_out()), SURE, FEW)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every near-duplicate group, by shingles of five words and a similarity of 0.8.

    NULL and empty texts are no copies of each other; rows with a NULL id stay.
    """
    small_batches(spark)
    return neardup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; a NULL source is a source."""
    small_batches(spark)
    return mixing.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a NULL or empty text has no ids."""
    small_batches(spark)
    return pieces.encode(docs, pieces.model_bytes()).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near-duplicates", one_of_each),
    ("mixing", mixed),
    ("tokens", token_ids),
]

#: No SQL trains a classifier, builds automata, fits subset sums or runs a tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda rows, stage: cut_lineage(stage[1](spark, rows, sf_dir)), STAGES, docs)
