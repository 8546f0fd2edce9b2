"""Helpers shared by the operators of this subpackage: texts as flat byte buffers, word spans and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text a task holds in numeric form at a time; a longer text is held alone

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_PRIMES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about CHUNK_BYTES: (first row, end row, bytes, offsets).

    A NULL counts as an empty text. The bytes are UTF-8; ``offsets`` has one entry more than rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` in the buffer, and the row it belongs to."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(raw), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread evenly."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = _PRIMES[which]
        ups = np.full(size, p, np.uint64)
        downs = np.full(size, np.uint64(pow(int(p), -1, 1 << 64)), np.uint64)
        ups[0] = downs[0] = 1
        have = (np.cumprod(ups), np.cumprod(downs))
        if size == CHUNK_BYTES + 1:
            _powers[which] = have
    return have


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes in every span, by differences of one running polynomial sum."""
    ups, downs = _powers_of(which, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * ups[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * downs[starts] + (ends - starts).astype(np.uint64))


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; NULL counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit(""))) % n


def crc_sql(value: str) -> str:
    """DuckDB's expression for the CRC-32 of a short ASCII text: bit by bit, as a fold over its bytes."""
    steps = f"flatten(list_transform(range(1, length({value}) + 1), lambda i: [ord({value}[i]), 0, 0, 0, 0, 0, 0, 0]))"
    bit = f"CASE WHEN xor(x, b) & 1 = 1 THEN xor(xor(x, b) >> 1, {0xEDB88320}) ELSE xor(x, b) >> 1 END"
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, {steps}::BIGINT[]), lambda x, b: {bit}), {0xFFFFFFFF}::BIGINT)"


def narrowed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that others, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever and as often as body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Python tasks get at most ``rows`` rows at a time: for rows with texts that repeat."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _matched(df: DataFrame, key: str, ids: DataFrame, how: str, most: int) -> DataFrame:
    name = ids.columns[0]
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, F.col(key) == F.col(name), how)


def rows_of(df: DataFrame, key: str, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """The rows of df whose ``key`` is in the one-column table ``ids``, which is stored and has no repeats.

    Up to ``most`` ids (a few MB) travel to the rows; with more the rows are shuffled to the ids.
    """
    return _matched(df, key, ids, "left_semi", most)


def rows_without(df: DataFrame, key: str, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """The other rows, those with a NULL key among them."""
    return _matched(df, key, ids, "left_anti", most)


def filtered(docs: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows, all columns, where the test that ``make`` builds in each task is true of ``column``."""
    at = docs.columns.index(column)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or in other case do no harm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(frugal(run), plain.schema).toDF(*docs.columns)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of batches; when a task ends, its free memory goes back to the system.

    Python workers serve one task after another, and what one leaves allocated counts against the next.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library, which has no such call
                pass

    return go


TEXT_ROWS = 1000  # rows with whole texts that a Python task should get at a time


def small_batches(spark: SparkSession) -> None:
    """Set the session to hand Python tasks TEXT_ROWS rows at a time, if it would hand them more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
