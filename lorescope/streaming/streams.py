"""Streaming forms: the same operators over files as they arrive.

Every sink is idempotent per batch: a batch that is replayed after a failure
overwrites its own folder, so results equal those of one batch run. Results that
add up are kept as one state that each batch replaces; results by key as a log of
what each batch changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from lorescope.functions.text import verdict
from lorescope.operators import metrics as M
from lorescope.operators import moments as P
from lorescope.operators import stats as S
from lorescope.operators import votes as V


def drain(stream: DataFrame, mode: str, path: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is there and stop; each batch is written to its own folder under ``path``.

    Called again with the same path, it goes on where it stopped.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _version(path: str, number: int) -> str:
    return f"{path}/state/version={number}"


def state_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a stream's state, oldest first."""
    place, store = _store(spark, f"{path}/state")
    names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
    return sorted(int(n.split("=")[1]) for n in names if store.exists(_store(spark, f"{path}/state/{n}/_SUCCESS")[0]))


def versioned(stream: DataFrame, mode: str, path: str, make: Callable[[DataFrame, DataFrame | None, int], DataFrame]) -> DataFrame:
    """Process what is there, keeping one state that every batch replaces, and return it.

    ``make`` gets a batch, the state before it (None at first) and the batch's
    number. Batch n reads the newest version below n, writes version n and drops
    what is older than the version it read. A replayed batch finds the version
    it started from, so it leaves the same state; two versions remain.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        older = [v for v in state_versions(spark, path) if v < number]
        before = spark.read.parquet(_version(path, older[-1])) if older else None
        make(batch, before, number).write.mode("overwrite").parquet(_version(path, number))
        for version in older[:-1]:
            place, store = _store(spark, _version(path, version))
            store.delete(place, True)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(_version(path, state_versions(spark, path)[-1]))


def fold(
    stream: DataFrame, path: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The merged state of a stream: ``partial`` reduces a batch to state rows, ``merge`` any state rows to one state."""

    def make(batch: DataFrame, before: DataFrame | None, number: int) -> DataFrame:
        rows = partial(batch)
        return merge(rows if before is None else before.unionByName(rows))

    return versioned(stream, "append", path, make)


def latest_complete(stream: DataFrame, path: str) -> DataFrame:
    """The result of a complete-mode stream."""
    return versioned(stream, "complete", path, lambda batch, before, number: batch)


TIER = 8  # segments of a level of the log that become one of the next


def _segment(path: str, level: int, upto: int) -> str:
    return f"{path}/log/{level}-{upto}"


def log_segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(level, last batch) of the complete segments of a change log."""
    place, store = _store(spark, f"{path}/log")
    names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
    return sorted(tuple(map(int, n.split("-"))) for n in names if store.exists(_store(spark, f"{path}/log/{n}/_SUCCESS")[0]))


def _logged(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("_batch", LongType())])


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    # Rows of a key meet before they are sorted: a task that reads the log sorts nothing.
    newest = rows.repartition(*keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def change_log(batch: DataFrame, number: int, keys: Sequence[str], path: str) -> None:
    """Store the changed rows of batch ``number``; what a batch writes follows its own size.

    Every TIER segments of a level merge into one of the next, newest row per key, so a row is written again once per
    level, and a log of n batches has about TIER * log(n) segments. All names follow from the number: a replayed batch
    writes the same again. Rows carry their batch, so a segment beside the ones it was made of changes nothing.
    """
    spark = batch.sparkSession
    batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(_segment(path, 0, number))
    level, span = 0, TIER
    while (number + 1) % span == 0:
        parts = [(level, n) for n in range(number - span + span // TIER, number + 1, span // TIER)]
        segments = log_segments(spark, path)
        have = [p for p in parts if p in segments]
        if have and (level + 1, number) not in segments:  # else a replay, which finds the merged segment and less of its parts
            rows = spark.read.schema(_logged(batch)).parquet(*[_segment(path, *p) for p in have])
            _newest(rows, keys).write.mode("overwrite").parquet(_segment(path, level + 1, number))
        for p in have:
            place, store = _store(spark, _segment(path, *p))
            store.delete(place, True)
        level, span = level + 1, span * TIER


_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State by key on local disk, of which a batch checkpoints only the changes."""
    before = {name: spark.conf.get(name, None) for name in _STATE_CONF}
    for name, value in _STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def latest_per_key(stream: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """The newest row of each key of an update-mode stream, from a log of the changes."""
    spark = stream.sparkSession
    with keyed_state(spark):
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, number: change_log(batch, number, keys, path))
            .start()
        )
        query.awaitTermination()
    segments = [_segment(path, *p) for p in log_segments(spark, path)]
    rows = spark.read.schema(_logged(stream)).parquet(*segments) if segments else spark.createDataFrame([], _logged(stream))
    return _newest(rows, keys).drop("_batch")


def running_stats(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and variance per key, for complete or update mode."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )


def stream_moments(vectors: DataFrame, vector: str, path: str) -> DataFrame:
    """Second-order statistics of a stream, in one state of one row."""
    state = fold(vectors, path, lambda batch: P.partial_moments(batch, vector), P.merge_states)
    return P.merge_moments(state)


def stream_topk(vectors: DataFrame, vector: str, key: str, k: int, path: str) -> DataFrame:
    """Top-k per dimension of a stream: the best of each batch's best."""
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.col("x").desc(), key))

    def best(rows: DataFrame) -> DataFrame:
        return rows.drop("place").withColumn("place", rank).filter(F.col("place") <= k)

    return fold(vectors, path, lambda batch: S.topk(batch, vector, key, k), best)


class ExpiringCounts(StatefulProcessor):
    """Votes per (probe, truth, answer) in a map state whose entries are forgotten some time after their last vote."""

    def __init__(self, key: str, forget_ms: int):
        self.key, self.forget_ms = key, forget_ms

    def init(self, handle) -> None:
        self.counts = handle.getMapState("counts", "gt_answer string, answer string", "freq bigint, equivalent boolean", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        added: dict[tuple, tuple[int, bool | None]] = {}
        for r in rows:
            n, said = added.get((r.gt_answer, r.answer), (0, None))
            added[r.gt_answer, r.answer] = n + 1, _either(said, r.equivalent)
        for entry, (n, said) in added.items():
            before = self.counts.getValue(entry) if self.counts.containsKey(entry) else (0, None)
            now = before[0] + n, _either(before[1], said)
            self.counts.updateValue(entry, now)
            yield Row(**{self.key: key[0], "gt_answer": entry[0], "answer": entry[1], "freq": now[0], "equivalent": now[1]})

    def close(self) -> None:
        pass


def _either(a: bool | None, b: bool | None) -> bool | None:
    return b if a is None else a if b is None else a or b


def stream_votes(votes: DataFrame, path: str, key: str = "probe_id", forget_after: float | None = None) -> DataFrame:
    """Majority per probe as votes arrive.

    State by key holds the counts per (probe, answer); a batch hands on only the counts it changed, and they are
    logged. The majority is a plain aggregate over the newest counts. With ``forget_after`` seconds, an answer without
    a new vote for so long leaves the state and the result, and counts from zero when it comes again; this state is
    read and written one entry at a time by Python, so without expiry the engine's own aggregate keeps the counts.
    """
    entry = [key, "gt_answer", "answer"]
    if forget_after is None:
        # Few votes of an entry lie in one file, so they are dealt to the state's tasks first and counted there.
        judged = votes.select(*entry, verdict(F.col("verdict_text")).alias("_said")).repartition(*entry)
        counts = judged.groupBy(*entry).agg(F.count(F.lit(1)).alias("freq"), F.bool_or("_said").alias("equivalent"))
        newest = latest_per_key(counts, entry, path)
    else:
        judged = votes.select(*entry, verdict(F.col("verdict_text")).alias("equivalent"))
        schema = f"`{key}` {votes.schema[key].dataType.simpleString()}, gt_answer string, answer string, freq bigint, equivalent boolean"
        processor = ExpiringCounts(key, max(1, int(1000 * forget_after)))
        counts = judged.groupBy(key).transformWithState(processor, schema, "Update", "ProcessingTime")
        seen = F.unix_millis(F.current_timestamp())
        newest = latest_per_key(counts.withColumn("_seen", seen), entry, path).filter(F.col("_seen") > seen - F.lit(int(1000 * forget_after))).drop("_seen")
    truth = newest.groupBy(key).agg(F.min("gt_answer").alias("gt_answer"))
    return V.majority(newest.drop("gt_answer"), truth, key)


def append_once(rows: DataFrame, keys: Sequence[str], path: str, late: str | None = None, event_time: str | None = None) -> DataFrame:
    """Append each key once, however often it arrives, resuming from the checkpoint.

    With ``event_time`` and ``late`` the keys remembered are limited to that
    delay; without them every key is remembered.
    """
    if event_time and late:
        unique = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))
    else:
        unique = rows.dropDuplicates(list(keys))
    query = (
        unique.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.parquet(f"{path}/data")


def stream_rates(judged: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """AP, FKE and HP rates per run key of judged items as they arrive, from counts that add up."""
    scored = judged.withColumn("ap", M.answer_pass(F.col("final_answer_correct"))).withColumn(
        "fke", M.facts_entailed(F.col("required_knowledge"))
    )

    def added(counts: DataFrame) -> DataFrame:
        return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts.columns if c not in by])

    return M.rates(fold(scored, path, lambda batch: M.cell_counts(batch, by), added))
