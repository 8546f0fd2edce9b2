"""Prefix trie of conversations: shared prefixes, subtrees, and what sharing them saves.

A burst trie. Equal conversations are counted once, as one sequence of turn ids with a weight. All sequences start in
one container under the root. A container with more sequences or turns than one task should hold bursts: what its
sequences share becomes a stretch of nodes of the trie head, and the next turn id deals them into new containers.
Containers that fit are dealt to tasks, sorted, and swept once with a stack into nodes. A container of one sequence
has no branch: its nodes follow from its rows one by one, so a conversation of any length is never held whole.

Sums over subtrees are complete within a swept container; those of the heads are added up from the containers below
them, round by round backwards. Bursting takes one round per branching of heads, however long their stretches are.

Cases: a NULL role or text counts as empty; a NULL turn comes first; turns of one conversation with the same number
are ordered by a digest of role and text; a NULL conv_id is a conversation without an id: it counts, but is not the
smallest member and not listed unless there is no other (then the id is NULL); a conversation without turns ends at
the root; an empty table has no nodes; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import crc_mod, crc_sql, frugal, small_batches
from lorescope.llm.registry import query
from lorescope.operators.ordering import position_in_group
from lorescope.session import cut_lineage, shuffle_width

MOST_SEQUENCES = 1000  # of a container that is swept
MOST_TURNS = 50_000  # of all its sequences below its top
MOST_LISTED = 10_000  # conversations with one end whose ids one row gathers; more are digested piece by piece
PIECE = 1 << 20  # characters of such a piece
STRIDE = 1 << 12  # turns summed by one step of a sum along a sequence

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, pos, tid, n_bytes) of every turn, a stored table: key is the id as text, tid a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("tid"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    return cut_lineage(position_in_group(rows, ["key"], [F.col("turn").asc_nulls_first(), F.col("tid")]).drop("turn"))


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (key, depth, tid, n_bytes) by turn from depth 1 on, and (key, conv_id) of each."""
    rows = turns.select("key", (F.col("pos") + 1).alias("depth"), "tid", "n_bytes")
    return rows, turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The same of conversations that start with turns of the first of their family.

    With h the CRC-32 of the id modulo ``heads``: the first h turns of conversation c - c % family, then the own ones
    after the first h.
    """
    h = crc_mod("key", heads)
    convs = cut_lineage(turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")))
    first = convs.select(F.col("key").alias("base"), F.col("n").alias("base_n"))
    convs = convs.withColumn("base", (F.col("conv_id") - F.col("conv_id") % family).cast("string"))
    convs = cut_lineage(convs.join(first, "base", "left").withColumn("lent", F.least(h, F.coalesce("base_n", F.lit(0))).cast("bigint")).select("key", "conv_id", "base", "lent"))
    own = turns.filter(F.col("pos") >= h).join(convs.select("key", "lent"), "key")
    own = own.select("key", (F.col("pos") - h + F.col("lent") + 1).alias("depth"), "tid", "n_bytes")
    lenders = turns.filter(F.col("pos") < heads).select(F.col("key").alias("base"), "pos", "tid", "n_bytes")
    lent = convs.filter("lent > 0").join(lenders, "base").filter("pos < lent").select("key", (F.col("pos") + 1).alias("depth"), "tid", "n_bytes")
    return own.unionByName(lent), convs.select("key", "conv_id")


def sequences(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq, n, first, len, ends) and their rows (seq, depth, tid, n_bytes), both stored.

    A sequence is known by its length and two hashes that add up over turns in any order, so nothing is gathered.
    """
    marks = [F.bit_xor(F.xxhash64("depth", "tid")).alias("m1"), F.bit_xor(F.xxhash64("tid", F.lit("again"), "depth")).alias("m2")]
    known = rows.groupBy("key").agg(F.count(F.lit(1)).alias("len"), *marks)
    same = ["len", "m1", "m2"]
    convs = cut_lineage(convs.join(known, "key", "left").fillna(0, same))
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key"))
    found = cut_lineage(convs.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), least.alias("least")))
    found = found.select(*same, "n", F.col("least.conv_id").alias("first"), F.col("least.key").alias("seq"))
    named = convs.filter("conv_id is not null")
    many = found.filter(F.col("n") > MOST_LISTED).select(*same)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    if many.isEmpty():
        ends = named.groupBy(*same).agg(F.sha2(ids, 256).alias("ends"))
    else:
        ends = named.join(many, same, "left_anti").groupBy(*same).agg(F.sha2(ids, 256).alias("ends"))
        ends = ends.unionByName(_long_lists(named.join(many, same, "left_semi").select(*same, "conv_id"), same))
    seqs = cut_lineage(found.join(ends, same, "left").select("seq", "n", "first", "len", F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends")))
    kept = rows.join(seqs.select("seq"), F.col("key") == F.col("seq"), "left_semi").withColumnRenamed("key", "seq")
    return seqs, cut_lineage(kept)


def _long_lists(rows: DataFrame, same: Sequence[str]) -> DataFrame:
    """SHA-256 of the comma-joined ascending ids per group: sorted over all tasks, joined to pieces there, and only the
    pieces meet, in order, one at a time."""
    schema = ", ".join(f"{c} bigint" for c in same)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ids() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in (*same, "conv_id")]
                yield from ((row[:-1], row[-1]) for row in zip(*columns))

        for group, members in groupby(ids(), lambda x: x[0]):
            start, parts, size = None, [], 0
            for _, i in members:
                start = i if start is None else start
                parts.append(str(i))
                size += len(parts[-1]) + 1
                if size >= PIECE:
                    yield _piece(group, start, parts)
                    start, parts, size = None, [], 0
            if parts:
                yield _piece(group, start, parts)

    def _piece(group: tuple, start: int, parts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(same, group)) | {"start": start, "piece": ",".join(parts)}])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in same], batch.column("piece").to_pylist())

        for group, members in groupby(rows_of(), lambda x: x[:-1]):
            digest = hashlib.sha256()
            for k, row in enumerate(members):
                digest.update(b"," * (k > 0) + row[-1].encode())
            yield pa.RecordBatch.from_pylist([dict(zip(same, group)) | {"ends": digest.hexdigest()}])

    order = [*same, "conv_id"]
    spread = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    cut = cut_lineage(spread.mapInArrow(frugal(pieces), f"{schema}, start bigint, piece string"))
    return cut.repartition(*same).sortWithinPartitions(*same, "start").mapInArrow(frugal(digests), f"{schema}, ends string")


def _down(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, depth, n_bytes, ...) with ``below``: bytes at and below each depth, by strides of depths."""
    stride = F.floor(F.col("depth") / STRIDE)
    later = W.partitionBy(key).orderBy(F.col("stride").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(key, stride.alias("stride")).agg(F.sum("n_bytes").alias("sum"))
    sums = sums.select(key, "stride", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("after"))
    within = W.partitionBy(key, "stride").orderBy(F.col("depth").desc())
    return rows.withColumn("stride", stride).join(sums, [key, "stride"]).withColumn("below", F.sum("n_bytes").over(within) + F.col("after")).drop("stride", "after")


def _swept(rows: list[dict]) -> Iterator[tuple]:
    """Nodes (box, top, *_NODE) of one container from its sequences, sorted by their suffixes."""
    at = rows[0]["at"]
    conv, depth, up, n, children, leaves, saved, ends, size = ([x] for x in (None, at, -1, 0, 0, 0, 0, _NO_ENDS, rows[0]["top_bytes"]))
    path, before = [0], ""

    def close() -> None:
        i = path.pop()
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * size[i]
        p = up[i]
        if p >= 0:
            n[p] += n[i]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            conv[p] = conv[i] if conv[p] is None else conv[p] if conv[i] is None else min(conv[p], conv[i])

    for row in rows:
        suffix, sizes = row["suffix"], row["sizes"]
        same, most = 0, min(len(before), len(suffix)) // 32
        while same < most and before[32 * same : 32 * same + 32] == suffix[32 * same : 32 * same + 32]:
            same += 1
        while len(path) - 1 > same:
            close()
        for k in range(same, len(sizes)):
            for column, value in zip((conv, depth, up, n, children, leaves, saved, ends, size), (None, at + k + 1, path[-1], 0, 0, 0, 0, _NO_ENDS, sizes[k])):
                column.append(value)
            path.append(len(conv) - 1)
        end = path[-1]
        n[end] += row["n"]
        ends[end] = row["ends"]
        if row["first"] is not None:
            conv[end] = row["first"] if conv[end] is None else min(conv[end], row["first"])
        before = suffix
    while path:
        close()
    for i in range(len(conv)):
        yield rows[0]["box"], i == 0, conv[i], depth[i], conv[up[i]] if i else rows[0]["above"], n[i], children[i], leaves[i], saved[i], ends[i]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["box", "top", *[c.split()[0] for c in _NODE.split(", ")]]
    kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
    nodes: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*nodes), kinds)], names=names)

    rows = (row for batch in batches for row in batch.to_pylist())
    for _, members in groupby(rows, lambda row: row["box"]):
        nodes.extend(_swept(list(members)))
        if len(nodes) >= MOST_TURNS:
            yield out()
            nodes.clear()
    if nodes:
        yield out()


def _node(conv: Column, depth: Column, parent: Column, n: Column, children: Column, leaves: Column, saved: Column, ends: Column) -> list[Column]:
    return [c.cast(t).alias(x) for c, (x, t) in zip((conv, depth, parent, n, children, leaves, saved, ends), (y.split() for y in _NODE.split(", ")))]


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes, see _NODE, of the conversations ``convs`` (key, conv_id) with the turns ``rows`` (key, depth, tid, n_bytes)."""
    small_batches(rows.sparkSession)
    seqs, turns = sequences(rows, convs)
    col, none, zero = F.col, F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    # Stored, so that the first container is a value of a column and joins by it like any other.
    members = cut_lineage(seqs.select("*", F.lit("").alias("box"), F.lit(None).cast("string").alias("parent"), zero.alias("at"), none.alias("above"), zero.alias("top_bytes")))
    heads: list[tuple[DataFrame, DataFrame]] = []
    settled = []
    while True:
        boxes = cut_lineage(members.groupBy("box", "parent", "at", "above", "top_bytes").agg(
            F.count(F.lit(1)).alias("n_seqs"), F.sum(col("len") - col("at")).alias("n_turns"), F.sum("n").alias("n"), F.min("first").alias("first")))
        full = (col("n_seqs") > 1) & ((col("n_seqs") > MOST_SEQUENCES) | (col("n_turns") > MOST_TURNS))
        over = boxes.filter(full).drop("parent", "at", "above", "top_bytes", "n", "first")
        settled.append(members.join(boxes.filter(~full).select("box", "n_seqs"), "box"))
        if over.isEmpty():
            break
        # What the sequences of a full container share from its top on, and the depth where they part.
        inside = members.join(over, "box")
        below = cut_lineage(turns.join(inside.select("seq", "box", "at", "n_seqs"), "seq").filter("depth > at"))
        levels = below.groupBy("box", "depth", "n_seqs").agg(F.count(F.lit(1)).alias("k"), F.min("tid").alias("low"), F.max("tid").alias("high"), F.min("n_bytes").alias("n_bytes"))
        levels = cut_lineage(levels.withColumn("shared", (col("k") == col("n_seqs")) & (col("low") == col("high"))))
        parting = levels.filter("not shared").groupBy("box").agg(F.min("depth").alias("parting"))
        inside = inside.join(parting, "box")
        ended = inside.filter("len < parting").select("box", "ends")
        head = cut_lineage(boxes.filter(full).join(parting, "box").join(ended, "box", "left"))
        stretch = levels.join(head.select("box", "parting"), "box").filter("depth < parting").select("box", "depth", "n_bytes")
        stretch = stretch.unionByName(head.select("box", col("at").alias("depth"), col("top_bytes").alias("n_bytes")))
        heads.append((head, stretch))
        turn = below.join(parting, "box").filter("depth = parting").select("seq", "tid", "n_bytes")
        onward = inside.join(turn, "seq").join(head.select("box", col("first").alias("_first")), "box")
        members = cut_lineage(onward.select(
            "seq", "n", "first", "len", "ends", F.md5(F.concat("box", "tid")).alias("box"), col("box").alias("parent"),
            col("parting").alias("at"), col("_first").alias("above"), col("n_bytes").alias("top_bytes")))
    settled = cut_lineage(reduce(DataFrame.unionByName, settled))
    # Containers of one sequence: a node per row. Only copies (n > 1) save anything, so only they need sums.
    alone = settled.filter("n_seqs = 1")
    line = turns.join(alone.select("seq", "at"), "seq").filter("depth > at").select("seq", "depth", "n_bytes")
    line = line.unionByName(alone.select("seq", col("at").alias("depth"), col("top_bytes").alias("n_bytes")))
    facts = alone.select("seq", "box", "n", "first", "len", "ends", "at", "above")
    line = line.join(facts, "seq")
    line = line.filter("n = 1").withColumn("below", zero).unionByName(_down(line.filter("n > 1"), "seq"))
    nodes = [cut_lineage(line.select("box", (col("depth") == col("at")).alias("top"), *_node(
        col("first"), col("depth"), F.when(col("depth") == col("at"), col("above")).otherwise(col("first")), col("n"), (col("depth") < col("len")).cast("int"),
        F.lit(1), (col("n") - 1) * col("below"), F.when(col("depth") == col("len"), col("ends")).otherwise(F.lit(_NO_ENDS)))))]
    # Containers of several: their suffixes, sorted, are swept where they lie.
    several = settled.filter("n_seqs > 1").drop("n_seqs", "parent", "len")
    texts = turns.join(several.select("seq", "at"), "seq").filter("depth > at").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("depth", "tid", "n_bytes"))).alias("suffix"))
    suffixes = several.join(texts, "seq", "left").drop("seq")
    suffixes = suffixes.withColumn("sizes", F.coalesce(col("suffix.n_bytes"), F.array().cast("array<bigint>"))).withColumn("suffix", F.coalesce(F.array_join(col("suffix.tid"), ""), F.lit("")))
    nodes.append(cut_lineage(suffixes.repartition("box").sortWithinPartitions("box", "suffix").mapInArrow(frugal(_sweep), f"box string, top boolean, {_NODE}")))
    # Heads, from the last round back: what their containers hold together.
    tops = reduce(DataFrame.unionByName, nodes).filter("top").select("box", "n_leaves", "saved_tokens")
    parents = settled.filter("parent is not null").select("box", "parent").distinct()
    for k in reversed(range(len(heads))):
        head, stretch = heads[k]
        sums = tops.join(parents, "box").groupBy(col("parent").alias("box")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rows = _down(stretch, "box").join(head.drop("n_turns", "top_bytes"), "box").join(sums, "box")
        last = col("depth") == col("parting") - 1
        made = cut_lineage(rows.select("box", (col("depth") == col("at")).alias("top"), *_node(
            col("first"), col("depth"), F.when(col("depth") == col("at"), col("above")).otherwise(col("first")), col("n"), F.when(last, col("kids")).otherwise(1),
            col("leaves"), (col("n") - 1) * col("below") + col("saved"), F.when(last, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)))))
        nodes.append(made)
        above = made.filter("top").select("box", "n_leaves", "saved_tokens")
        if k:  # its own containers that burst later are settled below it
            tops = tops.unionByName(above)
            parents = parents.unionByName(head.select("box", "parent"))
    return reduce(DataFrame.unionByName, nodes).drop("box", "top")


SQL = f"""
WITH turns AS MATERIALIZED (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid, strlen(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) - 1 AS pos FROM conversations),
convs AS MATERIALIZED (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM turns GROUP BY conv_id),
again AS (
  SELECT c, 0 AS part, pos, tid, size FROM convs JOIN turns ON conv_id = base AND pos < h
  UNION ALL SELECT c, 1, pos, tid, size FROM convs JOIN turns ON conv_id = c AND pos >= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, tid, size FROM again),
members AS MATERIALIZED (
  SELECT c, 0 AS d, '' AS path, 0 AS size FROM convs
  UNION ALL SELECT c, d, string_agg(tid, '') OVER (PARTITION BY c ORDER BY d), size FROM placed),
ended AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM members GROUP BY c) GROUP BY path),
nodes AS MATERIALIZED (SELECT d, path, any_value(size) AS size, min(c) AS conv, count(*) AS n FROM members GROUP BY d, path),
kids AS MATERIALIZED (SELECT path[1:32 * (d - 1)] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT u.path[1:32 * j] AS path, sum((u.n - 1) * u.size)::BIGINT AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM nodes) u LEFT JOIN kids k ON u.path = k.path GROUP BY 1)
SELECT v.conv AS conv_id, v.d::BIGINT AS depth, p.conv AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
  b.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN below b ON v.path = b.path LEFT JOIN kids k ON v.path = k.path LEFT JOIN ended e ON v.path = e.path
  LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[1:32 * (v.d - 1)]"""


@query("op13_trie", SQL)
def op13(spark, folder):
    small_batches(spark)
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{folder}/conversations.parquet"))))
