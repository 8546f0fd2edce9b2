"""Mixing sources to target weights by subset-sum budget fitting.

Targets share the words of all documents by source weight, up to a multiple of what a source has. Every document
is taken as often as its source's target holds the source whole; for the budget left, documents are counted by
exact length, bounded-knapsack dynamic programming picks how many of each length to take so that the lengths add
up to it, and seeded hashes pick the documents.

The dynamic programming works on counts by length, so it is bounded by the longest text and not by the rows: a
share of every length in proportion first, then long lengths greedily, then a table over the last WINDOW words.

Cases: a NULL text has no words, and documents without words are taken as often as their source whole; a NULL
source is a source, last in order; repeated rows are rows of their own; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import narrowed
from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0  # times a source may be taken
WINDOW = 1 << 17  # words over which sums are tabulated
MARKED = 256  # steps between two tables of sums that are kept; those between are made again
SLICES = 4096  # parts of a length's documents, by hash; only one of them needs an order


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target: shares of the whole, none above most * source_size.

    A common level times the weight, cut at the ceilings: sources are cut in the order of ceiling / weight, and
    the level is what is left over what weight is left. One row per source meets in the window.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = sources.withColumn("weight", weight).withColumn("_ceiling", most * F.col("source_size"))
    order = W.orderBy(F.col("_ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (whole - F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    placed = placed.withColumn("_level", level).withColumn("_cut", F.col("_ceiling") <= F.col("_level") * F.col("weight"))
    # The first source that is not cut sets the level for all behind it.
    final = F.min(F.when(~F.col("_cut"), F.struct(F.col("_ceiling") / F.col("weight"), "_level"))).over(
        W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )["_level"]
    return placed.withColumn("target", F.least("_ceiling", F.coalesce(final * F.col("weight"), F.col("_ceiling")))).select(
        "source", "source_size", "weight", "target"
    )


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """How many of each size to take, at most counts, so that they add up as near to budget as can be.

    Within the window the sum is the best there is, the lower of two as near; before it, sizes are taken in
    proportion and then the longest.
    """
    take = np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if budget <= 0 or whole == 0:
        return take
    if budget >= whole:
        return counts.copy()
    spare = min(budget, window // 2)
    share = max(0.0, (budget - spare) / whole)
    take = np.floor(counts * share).astype(np.int64)
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        more = min(int(counts[i] - take[i]), max(0, left - spare) // int(sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    # Bit s of reach is set when some choice of the sizes seen so far adds up to s common divisors.
    unit = int(np.gcd.reduce(sizes))
    whole_left, rest = divmod(left, unit)
    aim = whole_left + (2 * rest > unit)
    limit = whole_left + int(sizes.max()) // unit
    mask = (1 << (limit + 1)) - 1
    reach, steps, marks = 1, [], []
    for i in order[::-1]:  # short sizes first
        free, size, fold = int(counts[i] - take[i]), int(sizes[i]) // unit, 1
        if size > limit:
            continue
        free = min(free, limit // size)
        while free > 0 and not reach >> aim & 1:
            k = min(fold, free)
            if len(steps) % MARKED == 0:
                marks.append(reach)
            steps.append((i, k, k * size))
            reach |= reach << (k * size) & mask
            free -= k
            fold *= 2
    below = (reach & ((1 << (whole_left + 1)) - 1)).bit_length() - 1
    above = reach >> (whole_left + 1)
    above = whole_left + 1 + (above & -above).bit_length() - 1 if above else None
    at = below if above is None or left - below * unit <= above * unit - left else above
    while marks:  # what could be reached before each step, from the last mark on
        tail, before = steps[(len(marks) - 1) * MARKED :], [marks.pop()]
        for _, _, size in tail[:-1]:
            before.append(before[-1] | before[-1] << size & mask)
        for (i, k, size), reached in zip(reversed(tail), reversed(before)):
            if not reached >> at & 1:
                take[i] += k
                at -= size
        del steps[len(marks) * MARKED :]
    return take


def mixed_sources(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (times the mix takes the row) of every document."""
    sized = cut_lineage(
        narrowed(docs, ["doc_id", "source", "text"]).select(
            "doc_id", "source", n_words(F.col("text")).alias("size"),
            _draw(seed, F.col("doc_id"), F.col("text")).alias("draw"),
        )
    )
    sized = sized.withColumn("part", F.pmod("draw", F.lit(SLICES)).cast("int"))
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    goals = cut_lineage(goals.withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        frame["more"] = fitted(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["budget"].iloc[0]))
        return frame[["source", "size", "more"]]

    by_source = F.col("a.source").eqNullSafe(F.col("b.source"))
    budgets = counts.filter("size > 0").alias("a").join(goals.filter("budget > 0").alias("b"), by_source).select("a.source", "a.size", "a.n", "b.budget")
    plan = cut_lineage(budgets.groupBy("source").applyInPandas(fit, "source string, size long, more long").filter("more > 0"))

    # Which slices of a length are taken whole, and the one in which an order decides.
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    slices = sized.alias("a").join(plan.alias("b"), same).groupBy("a.source", "a.size", "a.part").agg(F.count(F.lit(1)).alias("n"), F.first("b.more").alias("more"))
    upto = W.partitionBy("source", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("left", F.col("more") - F.coalesce(F.sum("n").over(upto), F.lit(0))).filter("left > 0").select("source", "size", "part", "n", "left")
    slices = cut_lineage(slices)
    here = same & (F.col("a.part") == F.col("b.part"))
    placed = sized.alias("a").join(slices.alias("b"), here, "left").select("a.*", "b.n", "b.left")
    first = W.partitionBy("source", "size", "part").orderBy("draw", "doc_id")
    decided = placed.filter("n > left").withColumn("extra", (F.row_number().over(first) <= F.col("left")).cast("long"))
    plain = placed.filter("n is null or n <= left").withColumn("extra", F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long"))
    chosen = plain.unionByName(decided)
    return chosen.alias("a").join(F.broadcast(goals).alias("b") if goals.limit(100_001).count() <= 100_000 else goals.alias("b"), by_source).select(
        "a.doc_id", "a.source", "a.size", "b.source_size", "b.target", (F.col("b.whole") + F.col("a.extra")).alias("copies"), "a.draw"
    )


def mixture(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    plan = mixed_sources(docs, seed, weights, most).filter("copies > 0")
    # Rows that agree in id, source and text share a draw; their copies are added and dealt out again.
    plan = cut_lineage(
        plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("draw").alias("_draw")).agg(
            F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")
        )
    )
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # names with dots or in other case do no harm
    own = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "source", "text")}
    same = own["doc_id"].eqNullSafe(F.col("_id")) & own["source"].eqNullSafe(F.col("_source"))
    same &= _draw(seed, own["doc_id"], own["text"]) == F.col("_draw")

    def taken(which: str) -> DataFrame:
        return docs.toDF(*plain).join(plan.filter(which), same)

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_time", F.explode(F.sequence(F.lit(1), "_copies"))).select(*plain).toDF(*names)

    if plan.filter("_rows > 1").isEmpty():
        return repeated(taken("_rows = 1"))
    return repeated(taken("_rows = 1")).unionByName(repeated(taken("_rows > 1").dropDuplicates(["_id", "_source", "_draw"])))


@query("op3_mixing")
def op3(spark, folder):
    return mixed_sources(documents(spark, folder)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
