"""Merkle manifest of a table: a leaf a row, a subtree a group, a root over the subtrees, and a proof for every row.

Bitmap-rank indexing. The ids of a group are kept as compressed bitmaps, one container per 2**15 ids (positions while
few, bits when many), under a directory of row counts by radix, so no window or task sees more than 2**17 entries. A
leaf's place in its group is the rank of its id: the directory's count before its container and the set bits before
its position. Leaves are not sorted. Each meets its 511 neighbours in an array of slots, which is reduced three levels
at once; the tops of these arrays are nodes of the next round, until one is left per group.

Eight nodes in a row (the last run has fewer, even one) are replaced by the hash of their hexadecimal digests until
one remains: a group's subroot, a lone leaf itself. Subroots by group, NULL first and bytewise, give the root likewise.

Cases: rows with a NULL id come first; rows that share an id are ordered by their leaf, so repeated rows have equal
leaves side by side; ids may be negative; a NULL group is a group; NULL values have a digest of their own; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import crc_mod, crc_sql, frugal
from lorescope.llm.registry import documents, query
from lorescope.operators.ordering import dense_index, position_in_group
from lorescope.session import cut_lineage

FAN = 8
TILE_LEVELS = 3
TILE = FAN**TILE_LEVELS  # nodes of one slot array
LOW = 15  # bits of an id within its container
RADIX = 16  # bits of a container's number that one level of the directory resolves
FEW = 256  # ids up to which a container lists positions instead of 4 KB of bits
MOST_GROUPS = 200_000  # groups up to which their names travel to the rows

_PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes of the value as text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, hi, ids) with ids as (pos, n) to (g, hi, rows, low, bits, again): positions or bits, and ids of several rows."""
    again_type = pa.list_(pa.struct([("pos", pa.int32()), ("more", pa.int64())]))
    for batch in batches:
        lows, bits, again, rows = [], [], [], []
        for ids in batch.column("ids").to_pylist():
            pos = np.array([x["pos"] for x in ids], np.int64)
            n = np.array([x["n"] for x in ids], np.int64)
            rows.append(int(n.sum()))
            again.append([{"pos": int(p), "more": int(k) - 1} for p, k in zip(pos[n > 1], n[n > 1])])
            if len(pos) <= FEW:
                lows.append(pos.tolist())
                bits.append(None)
            else:
                marks = np.zeros(1 << LOW, np.uint8)
                marks[pos] = 1
                lows.append(None)
                bits.append(np.packbits(marks, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("g"), batch.column("hi"), pa.array(rows, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(bits, pa.binary()), pa.array(again, again_type)],
            names=["g", "hi", "rows", "low", "bits", "again"],
        )


def containers(rows: DataFrame) -> DataFrame:
    """Compressed bitmaps of the ids of ``rows`` (g, key): (g, hi, rows, low, bits, again, base), a stored table.

    ``base`` is the number of the group's rows with an id in an earlier container. Ids are counted where they are read
    before they meet, so an id of many rows is sent once a task.
    """
    ids = rows.filter("key is not null").groupBy("g", F.shiftright("key", LOW).alias("hi"), F.col("key").bitwiseAND((1 << LOW) - 1).cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    met = ids.groupBy("g", "hi").agg(F.collect_list(F.struct("pos", "n")).alias("ids"))
    made = cut_lineage(met.mapInArrow(frugal(_packed), "g bigint, hi bigint, rows bigint, low array<int>, bits binary, again array<struct<pos:int,more:bigint>>"))
    # Rows before a container: those before it under its prefix, before the prefix under its own, and so on.
    level, counts, bases = made.select("g", "hi", "rows"), made.select("g", F.col("hi").alias("p0"), F.lit(0).cast("bigint").alias("base")), []
    for k in range(4):
        parent = F.shiftright("hi", RADIX) if k < 3 else F.lit(0).cast("bigint")  # at the last level there is only the sign
        order = W.partitionBy("g", parent).orderBy("hi").rowsBetween(W.unboundedPreceding, -1)
        bases.append(level.select("g", F.col("hi").alias(f"p{k}"), parent.alias(f"p{k + 1}"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias(f"before{k}")))
        level = level.groupBy("g", parent.alias("hi")).agg(F.sum("rows").alias("rows"))
    counts = reduce(lambda a, k: a.join(bases[k], ["g", f"p{k}"]), range(4), counts)
    directory = counts.select("g", F.col("p0").alias("hi"), sum(F.col(f"before{k}") for k in range(4)).alias("base"))
    return cut_lineage(made.join(directory, ["g", "hi"]))


def rank_of(pos: Column) -> Column:
    """Rows of the joined container with an id before ``pos``: listed or set bits, and more rows of the same ids."""
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(pos, 3) + 1, F.lit(1))), 16, 10).cast("int")
    part = F.bit_count(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), pos.bitwiseAND(7)) - 1))
    dense = F.bitmap_count(F.substring("bits", F.lit(1), F.shiftright(pos, 3))) + F.coalesce(part, F.lit(0))
    sparse = F.size(F.filter("low", lambda p: p < pos))
    more = F.aggregate(F.filter("again", lambda a: a["pos"] < pos), F.lit(0).cast("bigint"), lambda s, a: s + a["more"])
    return F.col("base") + F.when(F.col("bits").isNotNull(), dense).otherwise(sparse) + more


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, grp, leaf, ...), a stored table, with g, idx (the leaf's place) and total; and the groups with g."""
    counted = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("key").isNull()).alias("unnamed"))
    groups = cut_lineage(dense_index(counted, [F.col("grp").asc_nulls_first()], "g"))
    names = groups.withColumnRenamed("grp", "_grp")
    known = rows.join(F.broadcast(names) if groups.count() <= MOST_GROUPS else names, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp", "grp")
    maps = containers(known.select("g", "key"))
    pos = F.col("key").bitwiseAND((1 << LOW) - 1).cast("int")
    keep = [*known.columns, "idx"]
    met = known.filter("key is not null").withColumn("hi", F.shiftright("key", LOW)).join(maps, ["g", "hi"]).withColumn("idx", F.col("unnamed") + rank_of(pos))
    alone = met
    parts = []
    if not maps.filter(F.size("again") > 0).isEmpty():
        shared = F.exists("again", lambda a: a["pos"] == pos)
        alone, tied = met.filter(~shared), met.filter(shared).select(*keep)
        parts.append(position_in_group(tied, ["g", "key"], ["leaf"], "_nth").withColumn("idx", F.col("idx") + F.col("_nth")))
    if not groups.filter("unnamed > 0").isEmpty():
        parts.append(position_in_group(known.filter("key is null"), ["g"], ["leaf"], "idx"))
    return reduce(lambda a, b: a.unionByName(b.select(*keep)), parts, alone.select(*keep)).drop("unnamed"), groups


def _reduced(nodes: list[str], first_level: int, total: int) -> list[list[str]]:
    """The nodes of a slot array and of each level above, up to TILE_LEVELS, while the group has several nodes."""
    levels = [nodes]
    for k in range(first_level, first_level + TILE_LEVELS):
        if total <= FAN**k:
            break
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    return levels


def _slotted(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[int], dict]]:
    """Row number, digests by slot, slot of each stored entry and the row itself of every tile."""
    for i, row in enumerate(batch.to_pylist()):
        nodes: list[str] = [""] * len(row["nodes"])
        slots = [x["slot"] for x in row["nodes"]]
        for slot, x in zip(slots, row["nodes"]):
            nodes[slot] = x["digest"]
        yield i, nodes, slots, row


def _tiles(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Slot arrays of ``nodes`` (g, idx, total, digest, ...): (g, idx of the array, total, nodes), a stored table."""
    entry = F.struct((F.col("idx") % TILE).cast("int").alias("slot"), "digest", *carry)
    return cut_lineage(nodes.groupBy("g", F.floor(F.col("idx") / TILE).cast("bigint").alias("idx"), "total").agg(F.collect_list(entry).alias("nodes")))


def _tops(tiles: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [_reduced(nodes, level, row["total"])[-1][0] for _, nodes, _, row in _slotted(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("idx"), batch.column("total"), pa.array(tops, pa.string())], names=["g", "idx", "total", "digest"])

    return tiles.mapInArrow(frugal(run), "g bigint, idx bigint, total bigint, digest string")


def _paths(tiles: DataFrame, above: DataFrame, level: int, carry: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """(g, idx, digest, carry, path, kept) of every node: its siblings, level by level, then those of its tile's top.

    ``above`` has (g, idx, path, kept) of each tile.
    """
    fields = {f.name: f.dataType for f in tiles.schema["nodes"].dataType.elementType.fields}
    types = {f.name: f.dataType for f in above.schema.fields}
    schema = ", ".join(["g bigint", "idx bigint", "digest string", *[f"`{c}` {fields[c].simpleString()}" for c in carry], f"path {_PATH}", *[f"`{c}` {types[c].simpleString()}" for c in kept]])
    names = ["g", "idx", "digest", *carry, "path", *kept]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[_arrow(fields[c].simpleString()) for c in carry], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])), *[_arrow(types[c].simpleString()) for c in kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, nodes, slots, row in _slotted(batch):
                levels, rest = _reduced(nodes, level, row["total"])[:-1], row["path"]
                shared: dict[int, list] = {}  # the path from a node's parent on, which its siblings have as well
                out = []
                for slot, x in zip(slots, row["nodes"]):
                    path = []
                    if levels:
                        if slot // FAN not in shared:
                            shared[slot // FAN] = [_beside(levels[k], slot // FAN**k) for k in range(1, len(levels))] + rest
                        path = [_beside(levels[0], slot), *shared[slot // FAN]]
                    out.append([row["g"], row["idx"] * TILE + slot, x["digest"], *[x[c] for c in carry], path or rest, *[row[c] for c in kept]])
                yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), kinds)], names=names)

    met = tiles.join(above.select("g", "idx", "path", *kept), ["g", "idx"])
    return met.mapInArrow(frugal(run), schema)


def _beside(level: list[str], i: int) -> dict:
    """The digests before and after node i in its run."""
    start = i - i % FAN
    return {"before": "".join(level[start:i]), "after": "".join(level[i + 1 : start + FAN])}


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[name]


def _tree(nodes: DataFrame, carry: Sequence[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """Tiles of every round, and the last node (g, digest) of every group; ``most`` is the largest total."""
    rounds, tops, carried = [], [], list(carry)
    while True:
        tiles = _tiles(nodes, carried)
        done = _tops(tiles, TILE_LEVELS * len(rounds))
        rounds.append(tiles)
        reach = TILE ** len(rounds)
        if most > reach:
            done = cut_lineage(done)
        tops.append(done.filter(F.col("total") <= reach).select("g", "digest"))
        if most <= reach:
            return rounds, reduce(DataFrame.unionByName, tops)
        nodes, carried = done.filter(F.col("total") > reach), []


def manifest(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Of ``rows`` (key, grp, leaf and the text columns ``carry``): key, carry, leaf, subroot, root and path.

    ``path`` has, from the leaf up to the root, the digests before and after the node in its run.
    """
    rows = cut_lineage(rows.select("key", "grp", "leaf", *carry))
    known, groups = placed(rows)
    largest = groups.agg(F.max("total").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not largest["n"]:
        return rows.select("key", *carry, "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(_PATH).alias("path"))
    rounds, subroots = _tree(known.withColumnRenamed("leaf", "digest"), ["key", *carry], largest["t"])
    subroots = cut_lineage(subroots)
    # The tree of subroots: the same, of one group whose nodes stand at their group's number.
    upper = subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("idx"), F.lit(largest["n"]).cast("bigint").alias("total"), "digest")
    upper_rounds, top = _tree(upper, [], largest["n"])
    above = top.select("g", F.lit(0).cast("bigint").alias("idx"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    for k in reversed(range(len(upper_rounds))):
        above = _paths(upper_rounds[k], above, TILE_LEVELS * k, [], ["root"]).select("g", "idx", "digest", "path", "root")
    ends = above.select(F.col("idx").alias("g"), F.lit(0).cast("bigint").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    # Down again. Groups that ended in a round take the path of their subroot, the others that of the round above.
    ends = cut_lineage(ends.join(groups.select("g", "total"), "g"))
    lower = None
    for k in reversed(range(len(rounds))):
        here = ends.filter((F.col("total") <= TILE ** (k + 1)) & (F.col("total") > (TILE**k if k else 0))).drop("total")
        above = here if lower is None else here.unionByName(lower)
        out = _paths(rounds[k], above, TILE_LEVELS * k, ["key", *carry] if k == 0 else [], ["subroot", "root"])
        if k:
            lower = cut_lineage(out.select("g", "idx", "path", "subroot", "root"))
    return out.select("key", *carry, F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _enc_sql(columns: Sequence[str]) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


def _levels_sql(name: str, start: str, depth: int) -> str:
    """Nodes of ``depth`` levels and, per row of ``start`` (row, g, i, n, h, c), siblings so far (s) and folded node (c)."""
    ctes = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT g, i, h, n FROM {start}), {name}_p0 AS MATERIALIZED (SELECT row, g, i, n, c, '' AS s FROM {start})"]
    for k in range(depth):
        ctes.append(f"""{name}_r{k} AS MATERIALIZED (SELECT g, i // {FAN} AS j, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY g, i // {FAN}),
{name}{k + 1} AS MATERIALIZED (SELECT g, j AS i, CASE WHEN n > {FAN**k} THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, n FROM {name}_r{k}),
{name}_p{k + 1} AS MATERIALIZED (SELECT p.row, p.g, p.i // {FAN} AS i, p.n,
  CASE WHEN p.n > {FAN**k} THEN sha256(array_to_string(hs[1:p.i % {FAN}], '') || c || array_to_string(hs[p.i % {FAN} + 2:], '')) ELSE c END AS c,
  CASE WHEN p.n > {FAN**k} THEN s || array_to_string(hs[1:p.i % {FAN}], '') || array_to_string(hs[p.i % {FAN} + 2:], '') ELSE s END AS s
  FROM {name}_p{k} p JOIN {name}_r{k} r ON p.g = r.g AND p.i // {FAN} = r.j)""")
    return ",\n".join(ctes)


DEPTH = 9  # levels that the SQL has: up to 8**9 rows a group and 8**5 groups
_OWN = ("doc_id", "source", "lang", "n_chars")
SQL = f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, {_enc_sql([*_OWN, "text"])} AS h,
    CASE WHEN {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_enc_sql([*_OWN, f"translate(text, '{_UPPER}', '{_SMALL}')"])}
      ELSE {_enc_sql([*_OWN, "text"])} END AS c
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, row) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_levels_sql("a", "placed", DEPTH)},
tops AS MATERIALIZED (SELECT g AS row, 0 AS g, g AS i, count(*) OVER () AS n, h, h AS c FROM a{DEPTH}),
ends AS MATERIALIZED (SELECT p.row, 0 AS g, p.g AS i, t.n, t.h, p.c, p.s AS below FROM a_p{DEPTH} p JOIN tops t ON t.i = p.g),
{_levels_sql("b", "ends", 5)}
SELECT l.doc_id, l.h AS leaf, e.h AS subroot, r.h AS root, sha256(e.below || p.s) AS proof_sha256, p.c AS folded_root, p.c = r.h AS verified
FROM leaves l JOIN ends e USING (row) JOIN b_p5 p USING (row) CROSS JOIN b5 r"""


@query("op12_manifest", SQL)
def op12(spark, folder):
    docs = documents(spark, folder)
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.when(crc_mod("doc_id", 3) == 0, F.translate("text", _UPPER, _SMALL)).otherwise(F.col("text"))
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("lang").alias("grp"), leaf_hash([*own, F.col("text")]).alias("leaf"), leaf_hash([*own, altered]).alias("changed")
    )
    made = manifest(rows, ["changed"]).withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return made.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
