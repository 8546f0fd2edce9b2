"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Every text becomes a few statistics. Cosines of random projections of them approximate a Gaussian
kernel; tasks sum the normal equations of the labelled rows, four folds apart, so that ridge scores
out of fold come from the same sums. Their isotonic fit on a fixed grid turns scores into shares of label 1.

Cases: a NULL text counts as empty and is scored like it; a row with a NULL id is scored and never
learned from; repeated rows are scored each; labels that are NULL are left out; an id labelled twice
counts with each label; without labels every score is 0.5. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.llm.common import crc_mod, filtered, frugal, lowered, narrowed, span_hashes, texts_of, word_spans
from lorescope.llm.registry import documents, query

N_STATS = 18
N_FOURIER = 256
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-3  # per labelled row
FOLDS = 4
GRID = 2000  # cells of the calibration grid
PARTS = 64  # most tasks that sum normal equations, each of PART_ROWS rows or more
PART_ROWS = 2000
THRESHOLD = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "point": b".,;:'\"?()-", "mark": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "line": b"\n",
}
_ENDS = np.zeros(256, bool)
_ENDS[list(_CLASSES["symbol"] + b"!")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of N_STATS numbers per text: shares of byte classes, word lengths, repetition."""
    out = np.zeros((len(column), N_STATS), np.float32)
    for row, end, raw, at in texts_of(column):
        size = np.diff(at).astype(np.float64)
        n = np.maximum(size, 1)

        def share(flags: np.ndarray, at=at, n=n) -> np.ndarray:
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return (total[at[1:]] - total[at[:-1]]) / n

        starts, ends, owner = word_spans(raw, at)
        words = np.bincount(owner, minlength=end - row).astype(np.float64)
        w = np.maximum(words, 1)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(owner, length, end - row) / w
        spread = np.sqrt(np.maximum(np.bincount(owner, length**2, end - row) / w - mean**2, 0))
        table = out[row:end]
        table[:, 0], table[:, 1] = np.log1p(size), np.log1p(words)
        table[:, 2], table[:, 3] = np.log1p(mean), np.log1p(spread)
        for i, members in enumerate(_CLASSES.values()):
            flags = np.zeros(256, bool)
            flags[list(members)] = True
            table[:, 4 + i] = np.sqrt(share(flags[raw]))
        table[:, 10] = share(raw >= 128)
        if len(starts):
            letters = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(_LETTER[raw], out=letters[1:])
            table[:, 11] = np.bincount(owner, _ENDS[raw[ends - 1]], end - row) / w
            table[:, 12] = np.bincount(owner, letters[ends] == letters[starts], end - row) / w
            h = span_hashes(lowered(raw), starts, ends)
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
            table[:, 13] = np.bincount(owner, same, end - row) / w
            pairs = h * np.uint64(31) + np.roll(h, -1)
            bounds = np.searchsorted(owner, np.arange(end - row + 1))
            for k in np.flatnonzero(words):
                a, b = bounds[k], bounds[k + 1]
                _, counts = np.unique(h[a:b], return_counts=True)
                table[k, 14] = np.log1p(len(counts)) - np.log1p(b - a)
                table[k, 15] = counts.max() / (b - a)
                table[k, 16] = len(np.unique(pairs[a : b - 1])) / max(b - a - 1, 1)
        table[:, 17] = np.log1p(words / (1 + table[:, 9].astype(np.float64) ** 2 * size))
    return out


@dataclass
class Model:
    """A few arrays of fixed size: standardisation, projections, ridge weights, calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    levels: np.ndarray
    shares: np.ndarray
    seed: int = 7

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        turn = rng.standard_normal((N_STATS, N_FOURIER)) / WIDTH
        shift = rng.uniform(0, 2 * np.pi, N_FOURIER)
        z = np.clip((stats - self.mean) / self.scale, -6, 6) @ turn + shift
        return np.hstack([np.cos(z) * np.sqrt(2 / N_FOURIER), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.fourier(stats.astype(np.float64)) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Share of label 1; a sliver of the raw score keeps texts of one calibration step in order."""
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip(0.995 * np.interp(raw, self.levels, self.shares) + 0.005 / (1 + np.exp(-raw)), 0, 1)


def _with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold and stats of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(2))
            flat = pa.array(stats.ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "fold", "stats"])

    return docs.select("doc_id", "fold", "text").mapInArrow(frugal(run), "doc_id bigint, fold int, stats array<float>")


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("stats")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


def _summed(rows: DataFrame, run, width: int) -> dict[int, np.ndarray]:
    """Sums of the vectors that tasks emit per fold, combined in two steps; at most FOLDS rows reach the driver."""
    import pandas as pd

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width)
        for blob in frame["state"]:
            total += np.frombuffer(blob)
        return pd.DataFrame({"fold": [frame["fold"].iloc[0]], "part": [0], "state": [total.tobytes()]})

    schema = "fold int, part int, state binary"
    states = rows.mapInArrow(frugal(run), schema)
    for keys in (["fold", F.col("part") % 8], ["fold"]):
        states = states.groupBy(*keys).applyInPandas(add, schema)
    return {r["fold"]: np.frombuffer(r["state"]).copy() for r in states.collect()}


def _state_rows(parts: dict[int, np.ndarray], part: int) -> pa.RecordBatch:
    folds = sorted(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(folds, pa.int32()), pa.array([part] * len(folds), pa.int32()), pa.array([parts[f].tobytes() for f in folds], pa.binary())],
        ["fold", "part", "state"],
    )


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """A model of ``labels.quality`` from the labelled documents for which ``learn`` holds.

    Labels, language, source and id pick the rows and folds; only the text is an input.
    """
    from pyspark import TaskContext

    chosen = docs if learn is None else docs.filter(learn)
    chosen = narrowed(chosen, ["doc_id", "text"]).withColumn("fold", (F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % FOLDS).cast("int"))
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null")
    kept = rows = _with_statistics(chosen).join(marks, "doc_id").repartition(PARTS).persist()
    try:

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(1 + 2 * N_STATS)
            for batch in batches:
                x = _stats_of(batch)
                sums += np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])
            yield _state_rows({0: sums}, TaskContext.get().partitionId())

        sums = _summed(rows, moments, 1 + 2 * N_STATS).get(0)
        if sums is None or not sums[0]:
            return Model(np.zeros(N_STATS), np.ones(N_STATS), None, np.zeros(1), np.full(1, 0.5))
        mean = sums[1 : 1 + N_STATS] / sums[0]
        scale = np.sqrt(np.maximum(sums[1 + N_STATS :] / sums[0] - mean**2, 1e-8))
        model = Model(mean, scale, None, np.zeros(1), np.full(1, 0.5))
        d = N_FOURIER + 1
        upper = np.triu_indices(d)
        size = len(upper[0])
        rows = rows.coalesce(int(np.clip(sums[0] // PART_ROWS, 1, PARTS)))

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for batch in batches:
                z, y = model.fourier(_stats_of(batch)), batch.column("y").to_numpy(zero_copy_only=False)
                folds = batch.column("fold").to_numpy(zero_copy_only=False)
                for f in np.unique(folds):
                    own = z[folds == f]
                    state = parts.setdefault(int(f), np.zeros(size + d + 1))
                    state[:size] += (own.T @ own)[upper]
                    state[size:-1] += own.T @ y[folds == f]
                    state[-1] += len(own)
            yield _state_rows(parts, TaskContext.get().partitionId())

        folds = _summed(rows, normal, size + d + 1)
        total = np.sum(list(folds.values()), axis=0)

        def solved(state: np.ndarray) -> np.ndarray:
            gram = np.zeros((d, d))
            gram[upper] = state[:size]
            gram += np.triu(gram, 1).T + RIDGE * max(state[-1], 1) * np.eye(d)
            return np.linalg.solve(gram, state[size:-1])

        outer = {f: solved(total - s) if total[-1] > s[-1] else solved(total) for f, s in folds.items()}
        model.weights = solved(total)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid = np.zeros((3, GRID))
            for batch in batches:
                stats, y = _stats_of(batch), batch.column("y").to_numpy(zero_copy_only=False)
                folds_here = batch.column("fold").to_numpy(zero_copy_only=False)
                z = model.fourier(stats)
                raw = np.empty(len(y))
                for f in np.unique(folds_here):
                    raw[folds_here == f] = z[folds_here == f] @ outer[int(f)]
                cell = np.clip((raw + 0.5) / 2 * GRID, 0, GRID - 1).astype(np.int64)
                for i, value in enumerate((np.ones(len(y)), y, raw)):
                    grid[i] += np.bincount(cell, value, GRID)
            yield _state_rows({0: grid.ravel()}, TaskContext.get().partitionId())

        grid = _summed(rows, cells, 3 * GRID)[0].reshape(3, GRID)
        model.levels, model.shares = isotonic(grid)
        return model
    finally:
        kept.unpersist()


def isotonic(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells of (rows, labels, scores): mean score and share of each block, both rising."""
    blocks: list[list[float]] = []
    for n, y, raw in grid.T:
        if not n:
            continue
        blocks.append([n, y, raw])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    n, y, raw = np.array(blocks).T
    return raw / n, y / n


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold, else 0) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    return filtered(docs, "text", lambda: lambda texts: model.score(statistics(texts)) >= threshold)


def held_out() -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return crc_mod("doc_id", 5) == 0


@query("op1_quality")
def op1(spark, folder):
    docs = documents(spark, folder)
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), learn=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
