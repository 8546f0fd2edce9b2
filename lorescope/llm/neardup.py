"""Near-duplicate documents by MinHash with tensored banding, confirmed on the full shingle sets.

Two collections of SIDE half-keys, each of ROWS minimum hashes, are drawn per document; table (i, j) is keyed
by half i of the first and half j of the second, so SIDE * SIDE tables cost 2 * SIDE * ROWS minimum hashes
instead of SIDE * SIDE * 2 * ROWS. A pair at similarity t meets in some table with probability
(1 - (1 - t**ROWS) ** SIDE) ** 2: 0.9998 at 0.8 with the values below.

Equal shingle sets are one representative from the start. Every bucket checks its members against its smallest
one, and links join components, so groups of copies cost one check a member. Members of one centre that are then
still in different components are compared in cells of bounded size by their full sets, and only links are
written out, so that no link of a bucket is lost. That last step is quadratic in work and in rows for large groups
whose members are all just below the threshold.

Cases: texts without words or NULL have an empty set and are alone; with fewer words than a shingle the whole
sequence is one; rows with a NULL id are alone with component NULL and kept; rows that share an id are one
document whose texts all count and which has one component (the distinct sets of an id are held together where
partners are checked against it); extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.llm.common import batch_rows, frugal, lowered, mixed, narrowed, rows_of, rows_without, span_hashes, texts_of, word_spans
from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage

SIDE = 9
ROWS = 2
N_MINS = 2 * SIDE * ROWS
CELL = 500_000  # shingles of a group compared with as many others in one step
CELL_MEMBERS = 2000  # members of a group compared with as many others in one step, about
TILE = 1024  # members on each side of the largest matrix
SHARE = 64  # members checked against one copy of a bucket's smallest

_GOLD = 0x9E3779B97F4A7C15
_TURN = [pow(_GOLD | 1, 2 * i + 3, 1 << 64) for i in range(64)]
_MUL = mixed(np.arange(1, N_MINS + 1, dtype=np.uint64) * np.uint64(_GOLD)) | np.uint64(1)
_ADD = mixed(np.arange(101, N_MINS + 101, dtype=np.uint64) * np.uint64(_GOLD))


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles."""
    for row, end, raw, at in texts_of(column):
        raw = lowered(raw)
        starts, ends, owner = word_spans(raw, at)
        h = span_hashes(raw, starts, ends)
        bounds = np.searchsorted(owner, np.arange(end - row + 1))
        grams = np.zeros(len(h), np.uint64)
        for i in range(words):
            grams[: len(h) - i] += h[i:] * np.uint64(_TURN[i])
        grams = mixed(grams)
        for k in range(end - row):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                whole = h[a:b] * np.array(_TURN[: b - a], np.uint64)
                yield mixed(whole.sum(keepdims=True) + np.uint64(b - a))
            else:
                yield grams[:0]


def minima(grams: np.ndarray) -> np.ndarray:
    """N_MINS minimum hashes of a set that is not empty."""
    low = np.full(N_MINS, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(grams), 8192):
        values = ((grams[None, a : a + 8192] + _ADD[:, None]) * _MUL[:, None]) >> np.uint64(32)
        low = np.minimum(low, values.min(1).astype(np.uint32))
    return low


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and its minimum hashes (NULL for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, mins = [], [], [], []
            for grams in shingle_sets(batch.column(1), words):
                n.append(len(grams))
                d1.append(int(grams.sum().view(np.int64)))
                d2.append(int(mixed(grams * np.uint64(3)).sum().view(np.int64)))
                mins.append(minima(grams).view(np.int32).tolist() if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(mins, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "d1", "d2", "mins"],
            )

    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, mins array<int>"
    return narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), schema)


def table_keys(reps: DataFrame) -> DataFrame:
    """One row (key, rep) per table and representative."""

    def half(side: int, i):
        return [F.get("mins", i * ROWS + (side * SIDE * ROWS + r)) for r in range(ROWS)]

    count = F.sequence(F.lit(0), F.lit(SIDE - 1))
    keys = F.flatten(F.transform(count, lambda i: F.transform(count, lambda j: F.xxhash64(i * SIDE + j, *half(0, i), *half(1, j)))))
    return reps.select("rep", F.explode(keys).alias("key"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * shared >= percent * united shingles, as a stored table.

    The text of b travels once per SHARE partners, that of a once per pair. An id with several texts is linked if
    one of them is.
    """
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = rows_of(narrowed(docs, ["doc_id", "text"]), "doc_id", ids)
    copies = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies"))
    first = (
        copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .join(texts, F.col("b") == F.col("doc_id"))
        .select("b", "salt", F.lit(None).cast("bigint").alias("a"), "text")
    )
    rest = (
        pairs.join(copies, "b")
        .withColumn("salt", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int"))
        .join(texts, F.col("a") == F.col("doc_id"))
        .select("b", "salt", "a", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bases = None, {}
        for batch in batches:
            out_a, out_b = [], []
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for (b, salt, a), grams in zip(keys, shingle_sets(batch.column(3), words)):
                if at != (b, salt):
                    at, bases = (b, salt), {}
                if a is None:  # sorts before its partners
                    bases[len(grams), int(grams.sum())] = grams
                    continue
                for base in bases.values():
                    shared = len(np.intersect1d(grams, base, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(grams) + len(base) - shared):
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = first.unionByName(rest).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")
    with batch_rows(docs.sparkSession, 256):
        return cut_lineage(rows.mapInArrow(frugal(run), "a bigint, b bigint").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in the links (a, b): the smallest id it is connected with, as a stored table.

    Every round takes the smallest label among neighbours and then the label of that label.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = cut_lineage(labels.join(near, F.col("id") == F.col("a")).select("id", "comp", F.least("comp", "near").alias("low")))
        of = lower.select(F.col("id").alias("of"), F.col("low").alias("lowest"))
        after = cut_lineage(lower.join(of, F.col("low") == F.col("of")).select("id", "comp", F.least("low", "lowest").alias("now")))
        changed = after.filter("now < comp").limit(1).count()
        labels = after.select("id", F.col("now").alias("comp"))
        if not changed:
            return labels


def _groups(stars: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """(b, id, comp, slices) of all centres b and members whose group holds several components, but for centre pairs.

    A group of more than CELL shingles or CELL_MEMBERS members in all is compared in slices.
    """
    members = stars.select("b", F.col("a").alias("member")).union(stars.select("b", F.col("b").alias("member"))).distinct()
    sizes = reps.groupBy(F.col("rep").alias("member")).agg(F.max("n_shingles").alias("size"))
    placed = members.join(labels.withColumnRenamed("id", "member"), "member", "left").join(sizes, "member")
    placed = placed.select("b", "member", F.coalesce("comp", "member").alias("comp"), "size")
    # A centre has met all its members, so two components matter only among three members or more.
    mixed_groups = placed.groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.ceil(F.greatest(F.sum("size") / CELL, F.count(F.lit(1)) / CELL_MEMBERS)).cast("int").alias("slices"),
    ).filter("n > 2 and low < high")
    return placed.join(mixed_groups.select("b", "slices"), "b").select("b", F.col("member").alias("id"), "comp", "slices")


def _pairs_within(groups: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in one group, on the full sets, as a stored table.

    Members are dealt into slices by a hash; every two slices meet in one cell, where products of membership
    matrices count what any two sets share, TILE members by TILE at a time. Only links are written out.
    """
    ids = cut_lineage(groups.select("id").distinct())
    texts = rows_of(narrowed(docs, ["doc_id", "text"]), "doc_id", ids)
    cells = (
        groups.withColumn("own", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("b", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "comp")
    )
    rows = cells.join(texts, F.col("id") == F.col("doc_id")).select("b", "p", "q", "own", "id", "comp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def links() -> Iterator[pa.RecordBatch]:
            own, ids, comps = (np.array([x[i] for x in held]) for i in range(3))
            size = np.array([len(x[3]) for x in held])
            for i, j, shared in _shared([x[3] for x in held]):
                rows, columns = slice(i, i + shared.shape[0]), slice(j, j + shared.shape[1])
                good = 100 * shared >= percent * (size[rows, None] + size[None, columns] - shared)
                good &= (shared > 0) & (comps[rows, None] != comps[None, columns]) & (ids[rows, None] != ids[None, columns])
                good &= (own[rows, None] != own[None, columns]) | (at[1] == at[2])
                x, y = np.nonzero(good)
                x, y = ids[x + i], ids[y + j]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.array(np.minimum(x, y), pa.int64())], ["a", "b"])

        for batch in batches:
            heads = zip(*[batch.column(i).to_pylist() for i in range(6)])
            for (b, p, q, own, id_, comp), grams in zip(heads, shingle_sets(batch.column(6), words)):
                if at != (b, p, q):
                    if len(held) > 1:
                        yield from links()
                    held, at = [], (b, p, q)
                held.append((own, id_, comp, grams))
        if len(held) > 1:
            yield from links()

    dealt = rows.repartition("b", "p", "q").sortWithinPartitions("b", "p", "q")
    with batch_rows(docs.sparkSession, 256):
        return cut_lineage(dealt.mapInArrow(frugal(run), "a bigint, b bigint").distinct())


def _shared(sets: list[np.ndarray], columns: int = 2048) -> Iterator[tuple[int, int, np.ndarray]]:
    """How many elements every two of the sets share, in tiles: first row, first column and counts.

    Tiles above the diagonal are left out, as they mirror those below.
    """
    tiles = []
    for low in range(0, len(sets), TILE):
        own = sets[low : low + TILE]
        flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(flat, kind="stable")
        tiles.append((low, len(own), flat[order], owner[order], *np.unique(flat, return_counts=True)))

    def membership(tile: tuple, part: np.ndarray) -> np.ndarray:
        _, n, flat, owner, *_ = tile
        a, b = np.searchsorted(flat, part[0], "left"), np.searchsorted(flat, part[-1], "right")
        column = np.searchsorted(part, flat[a:b])
        has = part[column] == flat[a:b]
        block = np.zeros((n, len(part)), np.float32)
        block[owner[a:b][has], column[has]] = 1
        return block

    for k, tall in enumerate(tiles):
        for wide in tiles[: k + 1]:
            same = tall is wide
            common = tall[4][tall[5] > 1] if same else np.intersect1d(tall[4], wide[4], assume_unique=True)
            total = np.zeros((tall[1], wide[1]), np.int64)
            for c in range(0, len(common), columns):
                left = membership(tall, common[c : c + columns])
                right = left if same else membership(wide, common[c : c + columns])
                total += np.rint(left @ right.T).astype(np.int64)
            yield tall[0], wide[0], total


def _same_document(members: DataFrame, several: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the texts of one id."""
    own = members.filter("rep is not null").join(several, "doc_id").select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return own.join(least, "doc_id").filter("rep > b").select(F.col("rep").alias("a"), "b").distinct()


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Every row's doc_id, n_shingles, component_id (the smallest id reachable by links) and kept."""
    sig = cut_lineage(signatures(docs, words))
    reps = cut_lineage(
        sig.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.min_by("mins", "doc_id").alias("mins"))
    )
    keys = table_keys(reps)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).filter("b < top").select("key", "b")
    stars = cut_lineage(keys.join(buckets, "key").filter("rep > b").select(F.col("rep").alias("a"), "b").distinct())
    members = sig.join(reps.select("rep", "n_shingles", "d1", "d2"), ["n_shingles", "d1", "d2"], "left")
    ids = sig.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = cut_lineage(ids.filter("n > 1").select("doc_id"))
    repeated = not several.isEmpty()
    found = confirmed(stars, docs, words, percent)
    if repeated:
        found = cut_lineage(found.union(_same_document(members, several)).distinct())
    labels = components(found)
    more = _pairs_within(cut_lineage(_groups(stars, labels, reps)), docs, words, percent)
    if not more.isEmpty():
        labels = components(found.union(more).distinct())
    placed = members.join(labels, F.col("rep") == F.col("id"), "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    )
    if repeated:  # a text without words follows the others of its document
        lowest = placed.join(several, "doc_id").groupBy(F.col("doc_id").alias("_of")).agg(F.min("component_id").alias("_low"))
        placed = placed.join(lowest, F.col("doc_id") == F.col("_of"), "left").withColumn("component_id", F.coalesce("_low", "component_id"))
    return placed.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their component, one per id; rows without an id stay."""
    found = cut_lineage(classes(docs, words, percent).select("doc_id", "kept"))
    gone = cut_lineage(found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    twice = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count(F.lit(1)).alias("n"))
    twice = cut_lineage(twice.filter("n > 1").select("_twice"))
    left = rows_without(docs, "doc_id", gone)
    if twice.isEmpty():
        return left
    return rows_without(left, "doc_id", twice).unionByName(rows_of(left, "doc_id", twice).dropDuplicates(["doc_id"]))


#: Every two texts that share a shingle, by their full sets, and the smallest id reachable over links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) c ON s.doc_id = c.x"""


@query("op10_neardup", SQL)
def op10(spark, folder):
    return classes(documents(spark, folder), words=4)
