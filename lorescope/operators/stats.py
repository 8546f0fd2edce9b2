"""Per-dimension statistics of feature vectors, counts, top-k and quantiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lorescope.functions.hashing import keep_fraction
from lorescope.operators.moments import _matrix
from lorescope.operators.ordering import dense_index, position_in_group
from lorescope.session import cut_lineage
from lorescope.sources.records import load_stat, save_stat


def long_vectors(df: DataFrame, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per dimension of each vector, values as doubles."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def vec_mean(df: DataFrame, vector: str) -> DataFrame:
    return long_vectors(df, vector).groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def norm_mean(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(l2_norm(F.col(vector))).alias("norm_mean"))


def vec_variance(df: DataFrame, vector: str) -> DataFrame:
    return long_vectors(df, vector).groupBy("dim").agg(
        F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.var_pop("x").alias("variance_biased"),
        F.stddev_samp("x").alias("stdev"), F.stddev_pop("x").alias("stdev_biased"),
    )


def integrate(df: DataFrame, vector: str, functions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Sum of f(x) over all values of each dimension, for each f."""
    return long_vectors(df, vector).groupBy("dim").agg(*[F.sum(f(F.col("x"))).alias(name) for name, f in functions.items()])


def combined(df: DataFrame, aggregates: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Several statistics in one pass over the data."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


MOST_BINS = 10_000_000  # rows of a dense count; sparse counts have no bound


def sparse_bincount(df: DataFrame, value: str) -> DataFrame:
    """Counts of the values that occur, and after each the number of bins up to the next one that are zero (``gap``)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    placed = dense_index(counts, ["bin"], "_at")
    following = placed.select((F.col("_at") - 1).alias("_at"), F.col("bin").alias("_next"))
    return placed.join(following, "_at", "left").select("bin", "n", F.coalesce(F.col("_next") - F.col("bin") - 1, F.lit(0)).alias("gap"))


def bincount(df: DataFrame, value: str) -> DataFrame:
    """Counts of 0..max, zeros included. Negative values, or a maximum of MOST_BINS and more, are errors: see ``sparse_bincount``."""
    counts = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    low, top = counts.agg(F.min("bin"), F.max("bin")).first()
    if low is not None and (low < 0 or top >= MOST_BINS):
        raise ValueError(f"counts of {low} to {top} are no dense table of at most {MOST_BINS} bins from 0")
    bins = df.sparkSession.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", "bin")
    return bins.join(counts, "bin", "left").fillna(0, ["n"])


def history(df: DataFrame, arrival: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All rows with their place in arrival order."""
    return dense_index(df, list(arrival), "place").select("place", *fields)


def topk(df: DataFrame, vector: str, key: str, k: int, largest: bool = True) -> DataFrame:
    """The k extreme values of each dimension and the rows they come from.

    Ranks are limited within each task before the shuffle, so a dimension
    receives at most k rows per task.
    """
    order = F.col("x").desc() if largest else F.col("x").asc()
    rank = F.row_number().over(W.partitionBy("dim").orderBy(order, F.col(key)))
    return long_vectors(df, vector, [key]).withColumn("place", rank).filter(F.col("place") <= k)


def sample_portion(df: DataFrame, key: str, portion: float) -> DataFrame:
    return df.filter(keep_fraction(F.col(key).cast("string"), portion))


def exact_quantiles(long: DataFrame, group: str, value: str, key: str, parts: Sequence[int], of: int) -> DataFrame:
    """Interpolated quantiles parts/of of each group, exact.

    Sample i of n stands at (i - 1/2)/n, the extremes at 0 and 1. Values are
    ranked across range-partitioned chunks, so a large group is not sorted by
    one task; only the ranks next to a wanted quantile leave that step. Ranks
    are computed in whole numbers. NULLs take no part.
    """
    long = long.filter(F.col(value).isNotNull())
    ranked = position_in_group(long.select(group, value, key), [group], [value, key], "_rank")
    sizes = long.groupBy(group).agg(F.count(value).alias("_n"))
    scaled = 2 * F.col("part") * F.col("_n") + F.lit(of)  # (q n + 1/2) * 2 of
    low = F.floor(scaled / F.lit(2 * of))
    wanted = (
        sizes.withColumn("part", F.explode(F.array(*[F.lit(p).cast("bigint") for p in parts])))
        .withColumn("_low", F.least(F.greatest(low, F.lit(1)), F.col("_n")))
        .withColumn("_high", F.least(F.greatest(low + 1, F.lit(1)), F.col("_n")))
        .withColumn("_frac", F.pmod(scaled, F.lit(2 * of)) / F.lit(2.0 * of))
        .withColumn("_rank", F.explode(F.array(F.col("_low") - 1, F.col("_high") - 1)))
    )
    near = ranked.join(wanted, [group, "_rank"]).groupBy(group, "part").agg(
        F.min(value).alias("_a"), F.max(value).alias("_b"), F.max("_frac").alias("_frac")
    )
    return near.select(group, "part", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("quantile"))


def kll_quantiles(long: DataFrame, group: str, value: str, quantiles: Sequence[float], k: int = 3072) -> DataFrame:
    """Quantiles from mergeable KLL sketches; the extremes are exact."""
    sketched = long.groupBy(group).agg(
        F.kll_sketch_agg_double(value, k).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("n")
    )
    def at(q: float) -> Column:
        inner = F.col("_lo") if q <= 0 else F.col("_hi") if q >= 1 else F.kll_sketch_get_quantile_double("_s", F.lit(q))
        return F.struct(F.lit(q).alias("quantile"), inner.alias("value"))

    values = F.explode(F.array(*[at(float(q)) for q in quantiles]))
    return sketched.withColumn("_q", values).select(group, "n", "_q.quantile", "_q.value")


def readout(df: DataFrame, vector: str, key: str, count: int = 1001) -> DataFrame:
    """Evenly spaced quantiles of every dimension."""
    return exact_quantiles(long_vectors(df, vector, [key]), "dim", "x", key, range(count), count - 1)


def quantile_normalize(df: DataFrame, vector: str, key: str, table: DataFrame, count: int = 1001) -> DataFrame:
    """Map each value to its quantile in [0, 1] by linear lookup in a readout.

    The readout has ``count`` numbers per dimension whatever the data size; it
    is shipped with the tasks.
    """
    entries = F.array_sort(F.collect_list(F.struct("part", "quantile")))
    curves = table.groupBy("dim").agg(F.transform(entries, lambda e: e["quantile"]).alias("q")).orderBy("dim")
    grid = np.array([r["q"] for r in curves.select("q").toLocalIterator()], float).reshape(-1, count)  # a row a dimension
    levels = np.arange(count) / (count - 1)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch.column(1))
            out = np.stack([np.interp(values[:, d], grid[d], levels) for d in range(values.shape[1])], axis=1)
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.clip(out, 0.0, 1.0).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, vector])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).dropna("any").mapInArrow(apply, f"{key} {kind}, {vector} array<double>")


def tally(spark: SparkSession, path: str, args: Mapping[str, str], compute: Callable[[], DataFrame]) -> DataFrame:
    """The state stored at ``path`` under the same arguments, computed and stored on first use."""
    state = load_stat(spark, path, args)
    if state is None:
        save_stat(compute(), path, args)
        state = load_stat(spark, path, args)
    return state
