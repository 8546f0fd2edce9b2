"""Sharding by extendible hashing.

Rows are addressed by the leading bits of a hash of their key. The directory starts with one bucket; only buckets
above the byte limit split on another bit, until every shard fits. A histogram over hash prefixes stands for the
rows while splitting, so the rows themselves are read twice, as (key, hash, bytes), and never moved to split.

A row larger than the limit, or rows of one key that are together, cannot be divided by bits of the key's hash:
such a shard has ``fits`` false. Cases: a NULL text has no bytes; a NULL key is a key; repeated rows count each;
an empty table has no shards; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage

LIMIT = 4 << 20
BITS = 60  # of the hash: 15 hexadecimal digits, so that any SQL engine has the same
MOST_SENT = 500_000  # shards up to which the directory is broadcast (about 20 MB)
STEP = 4  # levels the histogram is finer than an even spread needs


def address(key: Column) -> Column:
    """The first BITS bits of the MD5 of the key as text; NULL is a key of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\u0000"))), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(hashed: Column, depth: int | Column) -> Column:
    """The leading ``depth`` bits, as a number."""
    if isinstance(depth, int):
        return F.shiftright(hashed, BITS - depth) if depth else F.lit(0).cast("bigint")
    return F.call_function("shiftright", hashed, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows, fits) of the shards of ``rows`` (hash, bytes), as a stored table.

    Sums of all levels come from one histogram; what is still too large at its finest level goes on with a finer
    histogram of only its own rows.
    """
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(total / limit + 1))) + STEP)
    shards, left = None, rows
    while True:
        cells = cut_lineage(left.groupBy(_prefix(F.col("hash"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")))
        levels = F.explode(F.sequence(F.lit(low), F.lit(high)))
        sums = cells.select(levels.alias("depth"), "cell", "bytes", "rows")
        sums = sums.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
        nodes = cut_lineage(sums.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
        # A node is a shard if it needs or allows no split and its parent was split; the first level has no parent here.
        split = (F.col("bytes") > limit) & (F.col("rows") > 1) & (F.col("depth") < BITS)
        children = F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        over = nodes.filter(split).select((F.col("depth") + 1).alias("depth"), children)
        ended = nodes.filter(~split).withColumn("fits", F.col("bytes") <= limit)
        found = ended.filter(F.col("depth") == low).unionByName(ended.filter(F.col("depth") > low).join(over, ["depth", "prefix"]))
        large = nodes.filter(split & (F.col("depth") == high))
        shards = cut_lineage(found if shards is None else shards.unionByName(found))
        deeper = cut_lineage(large.select("prefix"))
        if high == BITS or deeper.isEmpty():
            return shards.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"), "fits")
        left = rows.withColumn("_cell", _prefix(F.col("hash"), high)).join(deeper, F.col("_cell") == F.col("prefix"), "left_semi").drop("_cell")
        low, high = high + 1, min(BITS, high + 2 * STEP)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, shard (its prefix bits), depth, shard_bytes, shard_rows and fits of every row."""
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), address(F.col(f"`{key}`")).alias("hash"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("bytes")
    )
    rows = cut_lineage(rows)
    shards = directory(rows, limit)
    # Every row meets the shard of its prefix among the depths in use; there are few, as hashes spread evenly. The
    # directory has a row per shard and travels to the rows up to a known size.
    depths = [r["depth"] for r in shards.select("depth").distinct().orderBy("depth").collect()]
    tried = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("hash"), d).alias("prefix")) for d in depths]) if depths else F.array()
    if not depths:
        tried = F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix")))
    few = shards.limit(MOST_SENT + 1).count() <= MOST_SENT
    placed = rows.select("key", "bytes", F.inline(tried)).join(F.broadcast(shards) if few else shards, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("prefix"), BITS, "0"), F.lit(BITS + 1) - F.col("depth"), F.col("depth")))
    return placed.select(F.col("key").alias(key), F.col("bytes").alias("n_bytes"), name.alias("shard"), "depth", "shard_bytes", "shard_rows", "fits")


SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15))::BIGINT AS h
  FROM documents),
nodes AS (
  SELECT d AS depth, h >> ({BITS} - d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM hashed, range(0, {BITS + 1}) t(d) GROUP BY 1, 2),
leaves AS (
  SELECT h.doc_id, h.n_bytes, h.h, min(n.depth) AS depth
  FROM hashed h JOIN nodes n ON h.h >> ({BITS} - n.depth) = n.prefix
  WHERE n.shard_bytes <= {LIMIT} OR n.shard_rows = 1 OR n.depth = {BITS}
  GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE lpad(ltrim(bin(n.prefix), '0'), l.depth::INTEGER, '0') END AS shard,
  l.depth::INTEGER AS depth, n.shard_bytes, n.shard_rows, n.shard_bytes <= {LIMIT} AS fits
FROM leaves l JOIN nodes n ON n.depth = l.depth AND n.prefix = l.h >> ({BITS} - l.depth)"""


@query("op5_sharding", SQL)
def op5(spark, folder):
    return shard(documents(spark, folder))
