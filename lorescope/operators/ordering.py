"""Positions in a global or per-group order without a single-task window.

A window over a whole table, or over one group that holds a third of it, runs
in one task. Here such rows are range-partitioned on (group, order), so a large
group is spread over many tasks, and only a few numbers per partition are
combined afterwards. Groups that comfortably fit a task use a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.session import cut_lineage, shuffle_width

GROUP_LIMIT = 2_000_000  # rows of a group one task may order
_SAMPLED = 1000  # sampled rows by which a group of that size is recognised
_LOCAL_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | row


def _spread(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """Range-partition and sort; keep the named columns and add ``_chunk`` (partition) and ``_local`` (row in it).

    The result is written out: range bounds come from sampling, and every later
    reader has to see the same chunks.
    """
    placed = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("__row", F.monotonically_increasing_id())
        .select(*keep, "__row")
    )
    return (
        cut_lineage(placed)
        .withColumn("__chunk", F.shiftright("__row", _LOCAL_BITS))
        .withColumn("__local", F.col("__row").bitwiseAND((1 << _LOCAL_BITS) - 1))
        .drop("__row")
    )


def dense_index(
    df: DataFrame, order: Sequence[str | Column], name: str = "idx", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the 0-based position of every row in ``order``, which must be unique.

    Only the columns in ``keep`` (all, if not given) are carried along.
    """
    placed = _spread(df, order, keep or df.columns)
    sizes = placed.groupBy("__chunk").agg((F.max("__local") + 1).alias("__size"))
    # One row per partition, so the unpartitioned window and the broadcast are bounded.
    before = W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__chunk", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    return (
        placed.join(F.broadcast(offsets), "__chunk")
        .withColumn(name, F.col("__offset") + F.col("__local"))
        .drop("__chunk", "__local", "__offset")
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "pos", limit: int | None = None
) -> DataFrame:
    """Add the 0-based position of every row within its group; keys must not be NULL.

    Groups of more than about ``limit`` rows are ordered across tasks. A sample
    finds them: which way a group takes changes its cost, not its result.
    """
    keys, limit = list(keys), GROUP_LIMIT if limit is None else limit
    fraction = min(1.0, _SAMPLED / limit)
    seen = df.select(*keys) if fraction == 1.0 else df.select(*keys).sample(fraction, seed=17)
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = counts.filter(F.col("__n") > limit * fraction).select(*keys)
    rows = found.collect()  # at most rows / limit keys
    within = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    if not rows:
        return df.withColumn(name, within)
    large = df.sparkSession.createDataFrame(rows, found.schema)
    small = df.join(F.broadcast(large), keys, "left_anti").withColumn(name, within)
    hot = df.join(F.broadcast(large), keys, "left_semi").select(*df.columns)
    return small.unionByName(_position_across_tasks(hot, keys, order, name))


def _position_across_tasks(df: DataFrame, keys: list[str], order: Sequence[str | Column], name: str) -> DataFrame:
    placed = _spread(df, [*keys, *order], df.columns)
    # In a sorted layout only the first group of a chunk can have rows in earlier chunks.
    heads = placed.filter("__local = 0").select("__chunk", *keys)
    sizes = (
        placed.select("__chunk", *keys)
        .join(F.broadcast(heads.select(*keys).distinct()), keys, "left_semi")
        .groupBy(*keys, "__chunk")
        .agg(F.count(F.lit(1)).alias("__size"))
    )
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select("__chunk", *keys, F.sum("__size").over(before).alias("__carried")).filter(
        "__carried is not null"
    )
    within = W.partitionBy("__chunk", *keys).orderBy("__local")
    return (
        placed.withColumn("__rank", F.row_number().over(within).cast("bigint"))
        .join(F.broadcast(carried), ["__chunk", *keys], "left")
        .withColumn(name, F.col("__rank") - 1 + F.coalesce("__carried", F.lit(0)))
        .drop("__chunk", "__local", "__rank", "__carried")
    )
