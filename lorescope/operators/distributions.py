"""Histograms of knowledge confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 11  # centred on 0.0, 0.1, ..., 1.0


def confidence_bin(hits: Column, total: Column) -> Column:
    """Bin 0..10 of hits/total with edges at odd twentieths, in whole numbers.

    Edge values such as 1/20 go to the upper bin, exactly, where floating
    point would decide by rounding. No votes count as confidence 0.
    """
    place = F.floor((20 * hits + total) / (2 * total))
    return F.when(total == 0, 0).otherwise(F.least(place, F.lit(BINS - 1))).cast("int")


def confidence_histogram(evaluated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Known and unknown counts per bin, as shares of all rows of the group; empty bins kept."""
    binned = evaluated.select(*by, "knowledgable", confidence_bin(F.col("n_truth"), F.col("n_votes")).alias("bin"))
    known = F.col("knowledgable")
    counts = binned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if((F.col("bin") == i) & known).alias(f"_k{i}") for i in range(BINS)],
        *[F.count_if((F.col("bin") == i) & ~known).alias(f"_u{i}") for i in range(BINS)],
    )
    bars = F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.col(f"_k{i}").alias("known"), F.col(f"_u{i}").alias("unknown")) for i in range(BINS)
    ]))
    return counts.select(*by, "_total", bars.alias("_b")).select(
        *by, "_b.*", (F.col("_b.known") / F.col("_total")).alias("known_ratio"), (F.col("_b.unknown") / F.col("_total")).alias("unknown_ratio")
    )
