"""Document fingerprints by winnowing, in SQL functions only.

Every GRAM words in a row have a hash; of every WINDOW grams in a row the smallest is chosen, the rightmost of
equal ones, and kept with its position. Texts that share GRAM + WINDOW - 1 words in a row share a fingerprint, and
nothing shorter than GRAM words matches. Words are runs of other than white space, in lower case.

Cases: a NULL text counts as empty; a text without words has no fingerprint, one with fewer words than a gram a
single one of all its words; two texts without fingerprints are alike (1), one with and one without are not (0);
rows with a NULL id come last in order; rows that share an id are ordered by their text; a single row is its own
next; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import narrowed
from lorescope.llm.registry import documents, query

GRAM = 3
WINDOW = 4
CHUNK_ROWS = 2000  # neighbouring documents one task orders
CHUNKS = 20_000  # at most, beyond which chunks grow

_LOW = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and as often as body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Array of (hash, pos): the chosen gram hashes of a text and the word each gram starts with, by position."""

    def gram_hash(hashes: Column, at: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, at + i) for i in range(gram)])

    def chosen(hashes: Column) -> Column:
        # The upper half orders by hash, the lower by position from the right.
        keyed = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(hashes) - gram, F.lit(0))),
            lambda i: F.shiftleft(F.shiftrightunsigned(gram_hash(hashes, i), 33), 32).bitwiseOR(F.lit(_LOW) - i),
        )
        return F.when(F.size(hashes) > 0, _let(keyed, minima)).otherwise(F.array().cast("array<bigint>"))

    def minima(keys: Column) -> Column:
        span, low = 1, keys
        while span < window:  # the least of 1, 2, 4, ... keys in a row
            step = min(span, window - span)
            low = _least_of_next(low, step)
            span += step
        return F.array_distinct(F.slice(low, F.lit(1), F.greatest(F.size(keys) - (window - 1), F.lit(1))))

    def placed(hashes: Column) -> Column:
        position = lambda key: (F.lit(_LOW) - key.bitwiseAND(F.lit(_LOW))).cast("int")
        return F.transform(chosen(hashes), lambda key: F.struct(gram_hash(hashes, position(key)).alias("hash"), position(key).alias("pos")))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), placed)


def _least_of_next(values: Column, step: int) -> Column:
    """Each value or the one ``step`` places on, whichever is less; the last ones stand alone."""
    return _let(values, lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda a, b: F.least(a, b)))


def hashes_of(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sets of fingerprint hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def digest(print_: Column) -> Column:
    """Number of fingerprints and a digest of all hashes and positions, as text."""
    return F.concat(F.size(print_).cast("string"), F.lit(":"), F.md5(F.to_json(print_)))


def _chunk_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value, by two searches of about sqrt(len(bounds)) steps."""

    def count(of: Column) -> Column:
        return F.size(F.filter(of, lambda b: b <= value))

    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.lit([p[0] for p in parts]).cast("array<bigint>")
    tails = F.array(*[F.lit(p[1:]).cast("array<bigint>") if p[1:] else F.array().cast("array<bigint>") for p in parts])
    return _let(count(heads), lambda n: F.when(n == 0, F.lit(0)).otherwise((n - 1) * step + 1 + count(F.get(tails, n - 1))))


def with_next(docs: DataFrame, make: dict[str, Column]) -> DataFrame:
    """doc_id, text, the columns of ``make`` and, as next_*, text and these of the next row by descending id.

    After the last row comes the first. Rows are dealt into ranges of ids; the first row of each range is also
    sent to the range before it, so that no task sees more than its range. There are CHUNKS ranges at most.
    """
    rows = narrowed(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    total = rows.count()
    n = min(CHUNKS, max(1, total // CHUNK_ROWS))
    bounds: list[int] = []
    if n > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * CHUNKS).alias("c")).first()["c"]
        bounds = sorted(set(cuts or []))
    chunk = _chunk_of(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), bounds).cast("int")
    # The head of a range is the next of the last row of the range above; the highest head follows the lowest range.
    # These windows run over one row per range.
    every = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = rows.groupBy(chunk.alias("_range")).agg(F.max("doc_id").alias("head"))
    above = F.coalesce(F.lead("_range").over(W.orderBy("_range")), F.min("_range").over(every))
    guests = heads.select("head", above.alias("above"))
    dealt = (
        rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("head")), "left")
        .withColumn("own", chunk)
        .select("doc_id", "text", F.explode(F.when(F.col("above").isNull(), F.array(F.struct("own", F.lit(False)))).otherwise(
            F.array(F.struct("own", F.lit(False)), F.struct(F.col("above").alias("own"), F.lit(True))))).alias("at"))
        .select("doc_id", "text", F.col("at.own").alias("chunk"), F.col("at.col2").alias("guest"))
        .repartition("chunk")
    )
    order = W.partitionBy("chunk").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    made = dealt.select("*", *[column.alias(name) for name, column in make.items()])
    return made.select(
        "doc_id", "text", "guest", *make, *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *make)]
    ).filter("not guest").drop("guest")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last third of code points replaced by the first as many of the next."""
    n = F.char_length(text)
    part = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - part), F.substring(next_text, F.lit(1), part))


@query("op9_winnowing")
def op9(spark, folder):
    rows = with_next(documents(spark, folder), {"print": fingerprint(F.col("text"))})
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "print", "next_print", fingerprint(F.col("edited")).alias("edited_print"),
    )
    rows = rows.select("*", hashes_of(F.col("print")).alias("own"), hashes_of(F.col("edited_print")).alias("other"), hashes_of(F.col("next_print")).alias("after"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("print")).alias("fingerprint"), digest(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
