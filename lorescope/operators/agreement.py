"""Agreement between raters, and between a judge and a human."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.functions.hashing import hash60
from lorescope.session import cut_lineage


def clean_label(label: Column) -> Column:
    """An annotator error (-1) counts as 0."""
    return F.greatest(label, F.lit(0))


def positive_rate(labels: DataFrame, by: Sequence[str] = ("model", "domain", "task")) -> DataFrame:
    return labels.groupBy(*by).agg(
        F.count("label").alias("n"),
        F.sum(clean_label(F.col("label"))).alias("positives"),
        F.avg(clean_label(F.col("label"))).alias("positive_rate"),
    )


def pair_raters(labels: DataFrame, first: str, second: str, keys: Sequence[str] = ("domain", "task", "idx")) -> DataFrame:
    """Labels two raters gave to the same thing, as label_1 and label_2."""
    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, clean_label(F.col("label"))))

    both = labels.filter(F.col("model").isin(first, second)).groupBy(*keys).agg(of(first).alias("label_1"), of(second).alias("label_2"))
    return both.dropna("any", subset=["label_1", "label_2"])


def joint_counts(pairs: DataFrame, by: Sequence[str], rollup: bool = False) -> DataFrame:
    """n, positives of each rater and joint positives; with totals when rolled up."""
    a, b = F.col("label_1") == 1, F.col("label_2") == 1
    grouped = pairs.rollup(*by) if rollup else pairs.groupBy(*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a).alias("positive_1"),
        F.count_if(b).alias("positive_2"),
        F.count_if(a & b).alias("joint_positive"),
    )


def cohen_kappa(counts: DataFrame) -> DataFrame:
    """Add kappa = (po - pe) / (1 - pe) from joint counts; NULL when chance alone agrees."""
    n = F.col("n").cast("double")
    p1, p2, both = F.col("positive_1") / n, F.col("positive_2") / n, F.col("joint_positive") / n
    observed = both + (1 - p1 - p2 + both)
    expected = p1 * p2 + (1 - p1) * (1 - p2)
    return counts.withColumn("kappa", F.try_divide(observed - expected, 1 - expected))


def precision_recall_f1(pairs: DataFrame, by: Sequence[str], truth: str = "label_2", judged: str = "label_1") -> DataFrame:
    """Scores of the judge against the human; 0 where a denominator is 0."""
    hit = F.count_if((F.col(truth) == 1) & (F.col(judged) == 1))
    said, real = F.count_if(F.col(judged) == 1), F.count_if(F.col(truth) == 1)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(hit, said).alias("precision"),
        ratio(hit, real).alias("recall"),
        ratio(2 * hit, said + real).alias("f1"),
    )


def annotation_pool(labels: DataFrame, probes: DataFrame, items: DataFrame, facts: DataFrame, code_domains: Sequence[str]) -> DataFrame:
    """What the raters saw for every label: the i-th probe or the i-th item of the domain.

    ``probes`` and ``items`` carry their index within the domain as ``idx``;
    ``facts`` carries ``item_id``, ``pos``, ``knowledge`` and ``answer``. Only
    the facts of labelled items are gathered.
    """
    base = labels.select("model", "domain", "task", "idx", clean_label(F.col("label")).alias("llm_label"))
    factuality = base.filter("task = 'factuality'").join(probes, ["domain", "idx"]).select(
        *base.columns, "question", F.concat(F.lit("Answer: "), "answer").alias("context")
    )
    # Read twice, and often small enough to be sent to the facts.
    wanted = cut_lineage(base.filter("task = 'necessity'").join(items, ["domain", "idx"]))
    is_code = F.col("domain").isin(*code_domains)
    lines = (
        facts.join(wanted.select("item_id", "domain").distinct(), "item_id")
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.when(is_code, F.col("answer")).otherwise(F.col("knowledge")).alias("line")))).alias("_l"))
        .select("item_id", F.array_join(F.transform("_l", lambda r: r["line"]), "\n").alias("_text"))
    )
    head = F.when(is_code, F.lit("Function Calls:\n")).otherwise(F.lit("Knowledge:\n"))
    necessity = wanted.join(lines, "item_id", "left").select(
        *base.columns, "question", F.concat(head, F.coalesce("_text", F.lit(""))).alias("context")
    )
    return factuality.unionByName(necessity)


def sample_per_task(pool: DataFrame, n: int, key: Sequence[str], by: Sequence[str] = ("task",)) -> DataFrame:
    """A fixed pseudorandom sample of n rows of each task."""
    draw = hash60(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(draw, *key))
    return pool.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
