"""Pooling and retrieval of vectors by dot product."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.operators.ordering import dense_index
from lorescope.operators.stats import l2_norm, long_vectors
from lorescope.session import cut_lineage

BLOCK = 4096  # vectors one task multiplies on each side
FEW_BLOCKS = 4  # facts up to so many blocks are met all: looking for bounds would cost more
_DIGITS = 9  # scores are compared to this precision, so that equal vectors tie


def masked_mean_pool(tokens: DataFrame, group: str, vector: str, mask: Column) -> DataFrame:
    """Average of the attended vectors of each group; the result has one entry per dimension."""
    means = long_vectors(tokens.filter(mask), vector, [group]).groupBy(group, "dim").agg(F.avg("x").alias("mean"))
    return means.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda r: r["mean"]).alias(vector)
    )


def _blocks(df: DataFrame, by: Sequence[str], block: int, rows: str, blocks: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(rows)).withColumn(blocks, F.ceil(F.col(rows) / block))


def _products(left: DataFrame, right: DataFrame, groups: Sequence[str], packs: int, k: int) -> DataFrame:
    """(query_id, fact_id, score) of the k best facts of each query of ``left`` within every cell it shares with ``right``.

    Both sides have ``groups``, which name a cell, and ``vector``. Cells are packed by hash, so that many small ones
    share a call, and each is one matrix product.
    """
    groups = list(groups)
    pack = F.pmod(F.xxhash64(*groups), F.lit(packs))
    q_kind, f_kind = left.schema["query_id"].dataType.simpleString(), right.schema["fact_id"].dataType.simpleString()

    def best(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        found = []
        if not q.empty and not f.empty:
            f = f.sort_values("fact_id", kind="stable")
            a = np.stack(q["vector"].to_list()).astype(np.float64)
            b = np.stack(f["vector"].to_list()).astype(np.float64)
            asked, ids = q["query_id"].to_numpy(), f["fact_id"].to_numpy()
            candidates = f.groupby(groups, sort=False).indices
            for group, rows in q.groupby(groups, sort=False).indices.items():
                columns = candidates.get(group)
                if columns is None:
                    continue
                scores = np.round(a[rows] @ b[columns].T, _DIGITS)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found.append(pd.DataFrame({
                    "query_id": np.repeat(asked[rows], top.shape[1]),
                    "fact_id": ids[columns][top].ravel(),
                    "score": np.take_along_axis(scores, top, axis=1).ravel(),
                }))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "fact_id": [], "score": []})

    pairs = left.withColumn("_pack", pack).groupBy("_pack").cogroup(right.withColumn("_pack", pack).groupBy("_pack"))
    return pairs.applyInPandas(best, f"query_id {q_kind}, fact_id {f_kind}, score double")


def _placed_first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "fact_id"))
    return found.withColumn("place", rank).filter(F.col("place") <= k)


def _reach(tops: Sequence[float]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """How many of the blocks with these largest norms, in falling order, could hold a score of at least ``least`` for a
    query of the norm: by Cauchy-Schwarz no score passes the product of the norms."""
    rising = -np.asarray(tops, np.float64)

    def count(norm: pd.Series, least: pd.Series) -> pd.Series:
        short = least.to_numpy(np.float64) - 2 * 10.0**-_DIGITS  # scores are rounded before they are compared
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(np.isnan(short) | (short <= 0), -np.inf, short / norm.to_numpy(np.float64))
        return pd.Series(np.searchsorted(rising, -need * (1 - 1e-12), side="right"))

    return count


def norm_plan(queries: DataFrame, facts: DataFrame, k: int, vector: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What has to be multiplied for an exact top k: the results within the block of the longest facts, and both sides
    of the other cells (query_id, _q, _f, vector) and (fact_id, _q, _f, vector), with their number of rows.

    Facts lie in blocks by falling norm. The k-th score within the first block bounds how far down a query has to look,
    and queries lie in blocks by that depth, so a vector goes only to cells it can matter in. One number a block
    reaches the driver.
    """
    spark = queries.sparkSession
    sized = facts.select("fact_id", F.col(vector).alias("vector"), l2_norm(F.col(vector)).alias("_norm")).filter("vector is not null")
    laid = cut_lineage(dense_index(sized, [F.col("_norm").desc(), F.col("fact_id")], "_at").withColumn("_f", F.floor(F.col("_at") / block).cast("bigint")).drop("_at"))
    tops = [r["m"] for r in laid.groupBy("_f").agg(F.max("_norm").alias("m")).orderBy("_f").select("m").toLocalIterator()]
    asked = cut_lineage(queries.select("query_id", F.col(vector).alias("vector"), l2_norm(F.col(vector)).alias("_norm")).filter("vector is not null"))
    n_queries = asked.count()
    first = F.lit(0).cast("bigint")
    near = asked.withColumns({"_q": F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // block)))), "_f": first}).select("query_id", "_q", "_f", "vector")
    heads = laid.filter("_f = 0").select("fact_id", "vector", F.explode(F.sequence(first, F.lit(max(0, -(-n_queries // block) - 1)).cast("bigint"))).alias("_q"), "_f")
    seeds = cut_lineage(_products(near, heads, ["_q", "_f"], max(1, -(-n_queries // block)), k))
    least = seeds.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_least"))
    depth = F.pandas_udf(_reach(tops), "long")
    deep = asked.join(least, "query_id", "left").withColumn("_blocks", depth("_norm", F.coalesce("_least", F.lit(float("nan"))))).filter("_blocks > 1")
    deep = dense_index(deep.select("query_id", "vector", "_blocks"), [F.col("_blocks").desc(), F.col("query_id")], "_at").withColumn("_q", F.floor(F.col("_at") / block).cast("bigint"))
    deep = cut_lineage(deep.drop("_at"))
    depths = [r["d"] for r in deep.groupBy("_q").agg(F.max("_blocks").alias("d")).orderBy("_q").select("d").toLocalIterator()]
    # Blocks of queries by falling depth: block j of the facts meets the first c_j of them.
    meets = [(j, int(np.searchsorted(-np.asarray(depths), -j, side="left"))) for j in range(1, max(depths, default=1))]
    met = spark.createDataFrame([m for m in meets if m[1]], "_f bigint, _c bigint")
    left = deep.select("query_id", "_q", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_blocks") - 1)).alias("_f"), "vector")
    right = laid.join(F.broadcast(met), "_f").select("fact_id", F.explode(F.sequence(first, F.col("_c") - 1)).alias("_q"), "_f", "vector")
    total = deep.agg(F.sum(F.col("_blocks") - 1)).first()[0] or 0
    return seeds, left, right, int(total + block * sum(c for _, c in meets))


def retrieve(
    queries: DataFrame, facts: DataFrame, k: int, by: Sequence[str] = (), vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """The k facts with the largest dot product for each query, within the same ``by`` group if given. Exact.

    Every pair of blocks is one small matrix product: no group has to fit one
    task, and a pair hands on k rows per query, not all scores. Without groups,
    blocks of many facts follow norms and pairs that cannot win are left out
    (``norm_plan``). Else both sides are cut into blocks by a hash of their id and all pairs
    are met; pairs are packed until a task call has about two blocks of rows, so
    many tiny groups share a call. ``queries`` has query_id, ``facts`` fact_id.
    """
    by = list(by)
    if not by and facts.limit(FEW_BLOCKS * block + 1).count() > FEW_BLOCKS * block:
        seeds, left, right, handled = norm_plan(queries, facts, k, vector, block)
        rest = _products(left, right, ["_q", "_f"], max(1, -(-handled // (2 * block))), k)
        return _placed_first(seeds.unionByName(rest), k)
    shapes = _blocks(queries, by, block, "_rq", "_nq"), _blocks(facts, by, block, "_rf", "_nf")
    shape = cut_lineage(shapes[0].join(shapes[1], by) if by else shapes[0].withColumn("_one", F.lit(1)).join(shapes[1].withColumn("_one", F.lit(1)), "_one").drop("_one"))
    handled = shape.agg(F.sum(F.col("_rq") * F.col("_nf") + F.col("_rf") * F.col("_nq"))).first()[0] or 0
    keys = [*[f"_g{i}" for i in range(len(by))], "_q", "_f"]
    counts = {} if by else shape.first().asDict()  # one row

    def placed(side: DataFrame, key: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        met = F.sequence(F.lit(0).cast("bigint"), F.col(other_n) - 1)
        sized = side.select(*by, key, vector).join(shape, by) if by else side.select(key, vector).withColumns({c: F.lit(counts[c]) for c in shape.columns})
        return sized.filter(F.col(other_n) > 0).select(
            *[F.col(c).alias(g) for c, g in zip(by, keys)], F.col(key).alias(key), F.col(vector).alias("vector"),
            F.pmod(F.xxhash64(key), F.col(own_n)).alias(own), F.explode(met).alias(other),
        )

    left = placed(queries, "query_id", "_q", "_f", "_nq", "_nf")
    right = placed(facts, "fact_id", "_f", "_q", "_nf", "_nq")
    return _placed_first(_products(left, right, keys, max(1, -(-int(handled) // (2 * block))), k), k)


def retrieve_best(queries: DataFrame, facts: DataFrame, by: Sequence[str], text: str, vector: str = "embedding") -> DataFrame:
    """Text of the best fact in each query's scope group; '' when the group has none."""
    best = retrieve(queries, facts, 1, by, vector).select("query_id", "fact_id", "score")
    texts = facts.select("fact_id", F.col(text).alias("_text")).dropDuplicates(["fact_id"])
    return queries.select("query_id", *by).join(best, "query_id", "left").join(texts, "fact_id", "left").select(
        "query_id", *by, "fact_id", "score", F.coalesce("_text", F.lit("")).alias("retrieved")
    )


# How a subquestion is put to the model, with and without a fact.
_ASK, _FACT = "Subquestion: ", "\nRelevant Fact: "
_WITH = "\n\nFrom the provided fact, answer the given subquestion as concisely as possible.\nAnswer:"
_WITHOUT = "\n\nAnswer the given subquestion as concisely as possible.\nAnswer:"


def use_if_relevant(asked: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Prompt for each subquestion; its fact goes in only when judged relevant.

    ``asked`` has subquestion and retrieved; ``verdicts`` the judge's reply.
    """
    relevant = F.contains(F.lower(F.coalesce("verdict_text", F.lit(""))), F.lit("yes")) & (F.col("retrieved") != "")
    rest = F.when(relevant, F.concat(F.lit(_FACT), "retrieved", F.lit(_WITH))).otherwise(F.lit(_WITHOUT))
    prompt = F.concat(F.lit(_ASK), "subquestion", rest)
    joined = asked.join(verdicts.select(key, "verdict_text"), key, "left")
    return joined.withColumns({"relevant": relevant, "prompt": prompt}).drop("verdict_text")
