"""Extension points: batch scorers, mergeable statistics, row expanders, judges."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lorescope.operators.joins import same_keys
from lorescope.operators.mining import CALL_FIELDS, call_rows
from lorescope.session import cut_lineage

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(df: DataFrame, make_scorer: Callable[[], Scorer], schema: str) -> DataFrame:
    """Run a user's batch function over all rows.

    ``make_scorer`` is called once per task, so a model or client is set up
    there and not per batch; the scorer gets and returns pandas batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)


def judge_once(requests: DataFrame, key: Sequence[str], make_scorer: Callable[[], Scorer], schema: str) -> DataFrame:
    """Score each distinct request once and hand the reply to all its rows.

    ``key`` are the columns the reply depends on; the scorer sees only those.
    """
    replies = score(requests.select(*key).distinct(), make_scorer, schema)
    return same_keys(requests, replies, key)


class Statistic(Protocol):
    """A mergeable statistic. States are bytes, so any representation will do."""

    def partial(self, rows: pd.DataFrame) -> Any: ...

    def merge(self, left: Any, right: Any) -> Any: ...

    def dump(self, state: Any) -> bytes: ...

    def load(self, data: bytes) -> Any: ...

    def finish(self, state: Any) -> dict[str, Any]: ...


def partial_states(df: DataFrame, statistic: Statistic, by: Sequence[str], held: int = 10_000) -> DataFrame:
    """States per task and key. At most ``held`` keys are kept open, then states are handed on early.

    Rows reach the statistic as pandas frames, where NaN and NULL of a fractional key are the same, NULL.
    """
    by = list(by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def rows(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, statistic.dump(s)) for k, s in states.items()], columns=[*by, "state"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                state = statistic.partial(part)
                states[key] = statistic.merge(states[key], state) if key in states else state
            if len(states) > held:
                yield rows(states)
                states = {}
        if states:
            yield rows(states)

    return df.mapInPandas(run, f"{kinds}, state binary")


def _same_key(left: tuple, right: tuple) -> bool:
    return all(a == b or (a != a and b != b) for a, b in zip(left, right))  # NaN is one key, as in a grouping


def merge_states(states: DataFrame, statistic: Statistic, by: Sequence[str], fan_in: int = 64) -> DataFrame:
    """One state per key, merged in a tree that grows with the number of states.

    Each round deals the states of a key into groups of about ``fan_in`` by their place in the stored table, so equal
    states spread as well, and merges a group while it streams past in key order: a task holds the sum and the state
    being added, however many there are. The last round leaves one group a key. NULL and NaN are keys.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    by = list(by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.select(*by).schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, types = None, None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip(at[:-1], types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([statistic.dump(total)], pa.binary())], [*by, "state"])

        for batch in batches:
            types = batch.schema.types[: len(by)]
            keys = zip(*[batch.column(i).to_pylist() for i in range(len(by) + 1)])
            for i, key in enumerate(keys):
                state = statistic.load(batch.column(len(by) + 1)[i].as_py())
                if at is not None and _same_key(at, key):
                    total = statistic.merge(total, state)
                else:
                    if at is not None:
                        yield row()
                    at, total = key, state
        if at is not None:
            yield row()

    while True:
        states = cut_lineage(states.select(*by, "state"))
        most = states.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return states
        width = math.ceil(most / fan_in)
        placed = states.withColumn("_place", F.monotonically_increasing_id())
        dealt = placed.withColumn("_group", F.pmod(F.xxhash64("_place"), F.lit(width)))
        ordered = dealt.repartition(*by, "_group").sortWithinPartitions(*by, "_group", "_place")
        states = ordered.select(*by, "_group", "state").mapInArrow(merge, f"{kinds}, state binary")
        if width == 1:
            return states


def finish_states(states: DataFrame, statistic: Statistic, by: Sequence[str], schema: str) -> DataFrame:
    """Results of merged states; ``schema`` names what ``finish`` returns, NaN among it is NULL."""
    by = list(by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.select(*by).schema)
    results = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [statistic.finish(statistic.load(s.as_py())) for s in batch.column(len(by))]
            columns = [pa.array([d[name] for d in done], kind, from_pandas=True) for name, kind in results]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*by, *[name for name, _ in results]])

    return states.select(*by, "state").mapInArrow(run, f"{kinds}, {schema}")


class CallExpander:
    """Table function: the library calls of a code cell."""

    def eval(self, code: str):
        yield from call_rows(code)


def register_functions(spark) -> None:
    """Make the table function available to SQL as ``library_calls(code)``."""
    spark.udtf.register("library_calls", F.udtf(CallExpander, returnType=CALL_FIELDS))


def stub_judge() -> Scorer:
    """A deterministic stand-in for a model: its reply depends on the MD5 of the request."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        text = batch.astype(str).agg("|".join, axis=1)
        even = text.map(lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 2 == 0)
        return batch.assign(verdict_text=even.map({True: "Yes, they agree.", False: "No, they differ."}))

    return run
