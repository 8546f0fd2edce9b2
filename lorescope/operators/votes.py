"""Semantic majority over sampled answers, and knowledge confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.functions.text import verdict, verdict_explanation
from lorescope.operators.joins import same_keys
from lorescope.session import shuffle_width


def answer_freq(votes: DataFrame, key: str = "probe_id", keep: Sequence[str] = ()) -> DataFrame:
    """Votes per distinct answer of each probe; ``keep`` are columns the answer determines."""
    return votes.groupBy(key, "answer").agg(F.count(F.lit(1)).alias("freq"), *[F.min(c).alias(c) for c in keep])


def distinct_requests(votes: DataFrame, key: str = "probe_id", keep: Sequence[str] = ()) -> DataFrame:
    """Each (probe, answer) once: what has to be judged, before any model call."""
    if not keep:
        return votes.select(key, "answer").distinct()
    return votes.groupBy(key, "answer").agg(*[F.min(c).alias(c) for c in keep])


def read_verdicts(judged: DataFrame, text: str = "verdict_text") -> DataFrame:
    return judged.withColumn("equivalent", verdict(F.col(text), "prefix")).withColumn(
        "explanation", verdict_explanation(F.col(text))
    )


def fan_out(votes: DataFrame, verdicts: DataFrame, key: str = "probe_id") -> DataFrame:
    """Give every vote the verdict of its distinct answer."""
    return same_keys(votes, verdicts.select(key, "answer", "equivalent", "explanation"), [key, "answer"])


def merge_equivalent(freq: DataFrame, verdicts: DataFrame, key: str = "probe_id") -> DataFrame:
    """Collapse the answers judged equal to the truth into one row per probe.

    ``merged_answer`` is NULL for that row, so no answer text can be taken for it.
    """
    judged = same_keys(freq, verdicts.select(key, "answer", "equivalent"), [key, "answer"])
    is_truth = F.coalesce("equivalent", F.lit(False))
    return judged.groupBy(key, is_truth.alias("is_truth"), F.when(~is_truth, F.col("answer")).alias("merged_answer")).agg(
        F.sum("freq").alias("freq")
    )


def majority(judged: DataFrame, truth: DataFrame, key: str = "probe_id") -> DataFrame:
    """Knowledge confidence and majority answer per probe.

    ``judged`` has one row per distinct answer with ``freq`` and ``equivalent``.
    The answers equal to the truth count together and win any tie; other ties go
    to the smallest text. ``truth`` has one row per probe with ``gt_answer``; a
    probe without votes gets NULL, false, 0.
    """
    is_truth = F.coalesce("equivalent", F.lit(False))
    tally = judged.groupBy(key).agg(
        F.sum("freq").alias("n_votes"),
        F.sum(F.when(is_truth, F.col("freq")).otherwise(0)).alias("n_truth"),
        # Most frequent other answer, ties by text, as one minimum.
        F.min(F.when(~is_truth, F.struct((-F.col("freq")).alias("less"), F.col("answer").alias("text")))).alias("_other"),
    )
    votes, hits = F.coalesce("n_votes", F.lit(0)), F.coalesce("n_truth", F.lit(0))
    other = F.coalesce(-F.col("_other.less"), F.lit(0))
    known = (hits > 0) & (hits >= other)
    return truth.join(tally, key, "left").select(
        key,
        votes.alias("n_votes"),
        hits.alias("n_truth"),
        F.coalesce(F.try_divide(hits, votes), F.lit(0.0)).alias("knowledge_confidence"),
        known.alias("knowledgable"),
        F.when(known, F.col("gt_answer")).otherwise(F.col("_other.text")).alias("majority_answer"),
        known.alias("majority_correct"),
        F.coalesce(F.try_divide(F.greatest(hits, other), votes), F.lit(0.0)).alias("majority_confidence"),
    )


def evaluate_probes(votes: DataFrame, verdicts: DataFrame, truth: DataFrame, key: str = "probe_id") -> DataFrame:
    """Votes judged by a separate verdict table."""
    judged = same_keys(answer_freq(votes, key), verdicts.select(key, "answer", "equivalent"), [key, "answer"])
    return majority(judged, truth, key)


def evaluate_judged(votes: DataFrame, truth: DataFrame, key: str = "probe_id", text: str = "verdict_text") -> DataFrame:
    """Votes that carry the judge's reply: counting and reading verdicts is one aggregate.

    Votes are dealt by probe to twice the tasks of a shuffle, so the tasks that sort them do not also hold the join
    they come from, and are not merged into fewer.
    """
    votes = votes.select(key, "answer", text).repartition(2 * shuffle_width(votes.sparkSession), key)
    return majority(read_verdicts(answer_freq(votes, key, [text]), text), truth, key)


def injection_effect(before: DataFrame, after: DataFrame, key: str = "probe_id") -> DataFrame:
    """Probe results before and after injection, side by side."""
    old = before.select(key, F.col("knowledgable").alias("known_before"), F.col("majority_answer").alias("answer_before"))
    new = after.select(key, F.col("knowledgable").alias("known_after"), F.col("majority_answer").alias("answer_after"))
    return old.join(new, key).withColumn("unchanged", F.col("answer_before").eqNullSafe(F.col("answer_after")))
