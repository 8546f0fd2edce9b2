"""Mergeable second-order statistics of feature vectors.

Every task reduces its vectors to a state of one row, matrices as bytes. States
of any tasks, batches or days merge into one in a tree, deviations corrected by
the distance of the means so that nothing is lost to cancellation; the long form,
one row per pair of dimensions, is made from the last state only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "n bigint, mean_i binary, mean_j binary, comoment binary, square_i binary, square_j binary"
OVERLAP_STATE = "n bigint, ones_i binary, ones_j binary, both binary"
MOMENTS = "i int, j int, n bigint, mean_i double, mean_j double, comoment double, square_i double, square_j double"
OVERLAPS = "i int, j int, n bigint, ones_i bigint, ones_j bigint, both bigint"
FAN = 32  # states that one task of a merge should get

Parts = tuple  # a count and the arrays of a state, in the order of its schema


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; vectors must have one length and no gaps."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError("vectors of different length")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a gap")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _triangle(matrix: np.ndarray) -> np.ndarray:
    """The upper triangle of a symmetric matrix, row by row: d(d+1)/2 numbers."""
    return matrix[np.triu_indices(len(matrix))]


def _square(entries: np.ndarray, side: int, other: int) -> np.ndarray:
    """The matrix of packed entries: a triangle, or all of them."""
    if side != other or len(entries) != side * (side + 1) // 2:
        return entries.reshape(side, -1)
    matrix = np.zeros((side, side), entries.dtype)
    matrix[np.triu_indices(side)] = entries
    return matrix + np.triu(matrix, 1).T


def _packed(state: Parts, schema: str) -> pa.RecordBatch:
    """A state as one row; of a matrix of vectors against themselves only the triangle."""
    if len(state[1]) == len(state[2]) and np.array_equal(state[1], state[2]) and np.array_equal(state[3], state[3].T):
        state = (*state[:3], _triangle(state[3]), *state[4:])
    names = [c.split()[0] for c in schema.split(", ")]
    arrays = [pa.array([state[0]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in state[1:]]]
    return pa.RecordBatch.from_arrays(arrays, names)


def _unpacked(batch: pa.RecordBatch, dtype: type) -> Iterator[Parts]:
    """Count, then arrays; the matrix among them is shaped by the first two, which go with its sides."""
    for row in range(batch.num_rows):
        n, *blobs = (batch.column(c)[row] for c in range(batch.num_columns))
        arrays = [np.frombuffer(x.as_buffer(), dtype).copy() for x in blobs]
        yield (n.as_py(), *[_square(x, len(arrays[0]), len(arrays[1])) if i == 2 else x for i, x in enumerate(arrays)])


def _joined(a: Parts | None, b: Parts) -> Parts:
    """Two moment states as one."""
    if a is None:
        return b
    (n, ai, aj, cross, si, sj), (m, bi, bj, other, ti, tj) = a, b
    di, dj, share = bi - ai, bj - aj, n * m / (n + m)
    return (
        n + m, ai + di * m / (n + m), aj + dj * m / (n + m), cross + other + share * np.outer(di, dj),
        si + ti + share * di * di, sj + tj + share * dj * dj,
    )


def _added(a: Parts | None, b: Parts) -> Parts:
    return b if a is None else tuple(x + y for x, y in zip(a, b))


def _reduced(df: DataFrame, left: str, right: str | None, one, join, schema: str) -> DataFrame:
    """One state per task of the vectors in ``left``, or of ``left`` against ``right``."""
    columns = [left] if right in (None, left) else [left, right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = join(state, one(_matrix(batch.column(0)), _matrix(batch.column(batch.num_columns - 1))))
        if state is not None:
            yield _packed(state, schema)

    return df.select(*columns).dropna("any").mapInArrow(run, schema)


def _merged(states: DataFrame, join, dtype: type, schema: str) -> DataFrame:
    """All states as one, in three rounds of a merge tree; each task holds one state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for other in _unpacked(batch, dtype):
                state = join(state, other)
        if state is not None:
            yield _packed(state, schema)

    names = [c.split()[0] for c in schema.split(", ")]
    states = states.select(*names)
    for _ in range(2):  # FAN tasks' states meet in one; adaptive execution joins these further while they are small
        states = states.repartition(F.floor(F.spark_partition_id() / FAN)).mapInArrow(run, schema)
    return states.repartition(1).mapInArrow(run, schema)


def _spread_out(state: DataFrame, dtype: type, schema: str) -> DataFrame:
    """The long form of a merged state, some rows of the matrix at a time."""
    kind = pa.int64() if dtype is np.int64 else pa.float64()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, left, right, matrix, *squares in _unpacked(batch, dtype):
                step = max(1, 100_000 // len(right))
                for start in range(0, len(left), step):
                    rows = slice(start, min(start + step, len(left)))
                    shape = (rows.stop - rows.start, len(right))
                    sides = [left[rows, None], right[None, :], matrix[rows], *([squares[0][rows, None], squares[1][None, :]] if squares else [])]
                    i, j = np.indices(shape)
                    arrays = [pa.array((i + start).ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(np.full(i.size, n), pa.int64())]
                    arrays += [pa.array(np.broadcast_to(x, shape).ravel(), kind) for x in sides]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return state.mapInArrow(run, schema)


def partial_moments(df: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """One state per task for the vectors in ``left``, or for ``left`` against ``right``."""

    def one(a: np.ndarray, b: np.ndarray) -> Parts:
        mean_a, mean_b = a.mean(axis=0), b.mean(axis=0)
        a, b = a - mean_a, b - mean_b
        cross = a.T @ b
        if right in (None, left):  # as a product may round both halves differently
            cross = (cross + cross.T) / 2
        return len(a), mean_a, mean_b, cross, (a * a).sum(axis=0), (b * b).sum(axis=0)

    return _reduced(df, left, right, one, _joined, STATE)


def merge_states(states: DataFrame) -> DataFrame:
    """One moment state from any number of them."""
    return _merged(states, _joined, np.float64, STATE)


def merge_moments(states: DataFrame) -> DataFrame:
    """One row per pair of dimensions from any number of states."""
    return _spread_out(merge_states(states), np.float64, MOMENTS)


def covariance(merged: DataFrame, unbiased: bool = True) -> DataFrame:
    less = 1 if unbiased else 0
    return merged.select("i", "j", F.try_divide("comoment", (F.col("n") - less).cast("double")).alias("covariance"))


def correlation(merged: DataFrame, undefined_as_zero: bool = False) -> DataFrame:
    """Correlation of each pair; NULL (or 0) where a dimension is constant."""
    value = F.try_divide(F.col("comoment"), F.sqrt("square_i") * F.sqrt("square_j"))
    if undefined_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    return merged.select("i", "j", value.alias("correlation"))


def second_moment(merged: DataFrame) -> DataFrame:
    """E[x_i x_j], not centred."""
    return merged.select("i", "j", (F.col("comoment") / F.col("n") + F.col("mean_i") * F.col("mean_j")).alias("moment"))


def partial_overlaps(df: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Per task: how often dimensions are positive together, and each alone."""

    def one(a: np.ndarray, b: np.ndarray) -> Parts:
        a, b = (a > 0).astype(np.float64), (b > 0).astype(np.float64)
        counts = (a.sum(axis=0), b.sum(axis=0), a.T @ b)
        return len(a), *[np.rint(x).astype(np.int64) for x in counts]

    return _reduced(df, left, right, one, _added, OVERLAP_STATE)


def merge_overlaps(states: DataFrame) -> DataFrame:
    """One overlap state from any number of them."""
    return _merged(states, _added, np.int64, OVERLAP_STATE)


def iou(states: DataFrame) -> DataFrame:
    """Intersection, union and their ratio for each pair of dimensions."""
    sums = _spread_out(merge_overlaps(states), np.int64, OVERLAPS)
    union = F.col("ones_i") + F.col("ones_j") - F.col("both")
    return sums.select(
        "i", "j", F.col("both").alias("intersection"), union.alias("union"),
        (F.col("both") / (union.cast("double") + F.lit(1e-20))).alias("iou"),
    )


def moment_matrix(moment: DataFrame) -> np.ndarray:
    """The d x d second moment on the driver, as one array."""
    entries = F.array_sort(F.collect_list(F.struct("i", "j", "moment")))
    flat = np.array(moment.agg(F.transform(entries, lambda e: e["moment"]).alias("m")).first()["m"], float)
    side = int(round(len(flat) ** 0.5))
    return flat.reshape(side, side)


def state_moment(state: DataFrame) -> np.ndarray:
    """The d x d second moment on the driver, read from the one row of a merged state."""
    row = state.select("n", "mean_i", "comoment").first()
    mean = np.frombuffer(row["mean_i"])
    return _square(np.frombuffer(row["comoment"]), len(mean), len(mean)) / row["n"] + np.outer(mean, mean)


def multiplied(df: DataFrame, matrix: np.ndarray, key: str, vector: str) -> DataFrame:
    """Every vector times a d x d matrix, which travels with the tasks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _matrix(batch.column(1)) @ matrix.T
                offsets = np.arange(0, turned.size + 1, turned.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(turned.ravel()))], names=[key, vector])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).dropna("any").mapInArrow(apply, f"{key} {kind}, {vector} array<double>")


def whiten(df: DataFrame, moment: DataFrame | np.ndarray, key: str, vector: str) -> DataFrame:
    """Direction of (second moment)^-1 x for every vector x, with unit length.

    The moment, a matrix, a merged state or the long form, is d x d whatever the
    number of rows. The inverse factor L^-1 of its Cholesky factors L L' is
    shipped with the tasks and applied twice; a moment without full rank has no
    inverse and is an error.
    """
    if isinstance(moment, DataFrame):
        moment = state_moment(moment) if "comoment" in moment.columns else moment_matrix(moment)
    half = np.linalg.inv(np.linalg.cholesky(moment))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = (_matrix(batch.column(1)) @ half.T) @ half
            turned /= np.linalg.norm(turned, axis=1, keepdims=True)
            offsets = np.arange(0, turned.size + 1, turned.shape[1], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(turned.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, vector])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).dropna("any").mapInArrow(apply, f"{key} {kind}, {vector} array<double>")
