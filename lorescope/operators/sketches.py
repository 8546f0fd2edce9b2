"""Mergeable quantile states: a KLL sketch per dimension that can be stored, merged, and asked for quantiles and ranks.

States of tasks, days and batches merge by plain aggregates that combine before the shuffle; nothing is sorted. A value
read from a state of K items has a rank within ERROR of the one asked for, whatever the number of merges; the extremes
are exact. ``stats.exact_quantiles`` and ``stats.readout`` give exact values for a total sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.operators.stats import long_vectors, quantile_normalize
from lorescope.streaming.streams import fold

K = 3072  # items a sketch keeps per level, about
ERROR = 0.002  # share of n by which a rank may be off


def quantile_states(df: DataFrame, vector: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """One state per dimension (and ``by``) of the vectors: n, lo, hi, sketch. NULLs and NaNs take no part."""
    long = long_vectors(df, vector, by).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return value_states(long, [*by, "dim"], "x", k)


def value_states(rows: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One state per group of the values."""
    x = F.col(value).cast("double")
    return rows.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.kll_sketch_agg_double(x, k).alias("sketch"))


def merge_quantile_states(states: DataFrame, by: Sequence[str] = ("dim",), k: int = K) -> DataFrame:
    """One state per group from any number of them."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def state_quantiles(states: DataFrame, count: int = 1001, by: Sequence[str] = ("dim",)) -> DataFrame:
    """Evenly spaced quantiles of every state, as ``stats.readout`` gives them: part of count - 1, quantile.

    A state is read once, for all of them.
    """
    inner = F.array(*[F.lit(p / (count - 1)) for p in range(1, count - 1)])
    values = F.concat(F.array("lo"), F.kll_sketch_get_quantile_double("sketch", inner), F.array("hi")) if count > 2 else F.array("lo", "hi")
    return states.select(*by, "n", F.posexplode(values).alias("part", "quantile"))


def state_ranks(states: DataFrame, values: Sequence[float], by: Sequence[str] = ("dim",)) -> DataFrame:
    """(by, value, rank): the share of each state's values that are not above each of the given values.

    A state is read once, for all of them. To map the vectors of a table use ``sketch_normalize``.
    """
    asked = [float(v) for v in values]
    ranks = F.kll_sketch_get_rank_double("sketch", F.array(*[F.lit(v) for v in asked]))
    pairs = F.inline(F.arrays_zip(F.array(*[F.lit(v) for v in asked]).alias("value"), ranks.alias("rank")))
    inside = F.when(F.col("value") < F.col("lo"), 0.0).when(F.col("value") >= F.col("hi"), 1.0).otherwise(F.col("rank"))
    return states.select(*by, "lo", "hi", pairs).select(*by, "value", inside.alias("rank"))


def sketch_readout(df: DataFrame, vector: str, count: int = 1001, k: int = K) -> DataFrame:
    """Evenly spaced quantiles of every dimension, each within ERROR of its rank; no sort, one row a task and dimension moves."""
    return state_quantiles(quantile_states(df, vector, k=k), count)


def sketch_normalize(df: DataFrame, vector: str, key: str, states: DataFrame, count: int = 1001) -> DataFrame:
    """Map each value to its quantile in [0, 1] as the states have it."""
    return quantile_normalize(df, vector, key, state_quantiles(states, count), count)


def stream_quantiles(vectors: DataFrame, vector: str, path: str, k: int = K) -> DataFrame:
    """The states of a stream: every batch's states merge into those kept."""
    return fold(vectors, path, lambda batch: quantile_states(batch, vector, k=k), lambda states: merge_quantile_states(states, k=k))


def near(value: Column, wanted: Column, n: Column, below: Column, upto: Column) -> Column:
    """Whether ``value``, with ``below`` of n values under it and ``upto`` not above it, has the wanted rank within ERROR."""
    room = F.lit(ERROR) * n + 1
    return value.isNotNull() & (below <= wanted * n + room) & (upto >= wanted * n - room)
