"""Streaming runs over the tables, fed in several batches, and extension points."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import moments as P
from lorescope.operators import plugins as U
from lorescope.operators import sketches as K
from lorescope.operators.reshape import nest
from lorescope.operators.verdicts import judge_stored
from lorescope.plans.metric_queries import rounded
from lorescope.plans.mining_queries import _CALLS_SQL, cells
from lorescope.plans.registry import Inputs, query
from lorescope.plans.vector_queries import _NEAR, _PAIRS, near_quantiles
from lorescope.plans.vote_queries import _EVALUATED
from lorescope.session import scratch_path
from lorescope.sources import records as A
from lorescope.streaming import streams as T

BATCHES = 4  # in which the files arrive, or one less


def arriving(t: Inputs, rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Rows written as several files and read back as a stream, and the folder they are in.

    Every task that makes rows writes its own file, so a file is as small as a task however many rows a batch has;
    only rows of too few tasks for the batches are dealt out once more.
    """
    path = scratch_path(t.spark, label)
    rows.write.parquet(path)
    files = len(t.spark.read.parquet(path).inputFiles())
    if files < BATCHES:
        few, path, files = t.spark.read.schema(rows.schema).parquet(path), scratch_path(t.spark, label), BATCHES
        few.repartition(BATCHES).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", math.ceil(files / BATCHES)).parquet(path), path


@query("t1_stream_stats", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, min(value) AS low, max(value) AS high
    FROM {events} GROUP BY event_type""")
def t1(t):
    path = scratch_path(t.spark, "stream-stats")
    stream, _ = arriving(t, t.events, "events")
    return rounded(T.latest_complete(T.running_stats(stream, "event_type", "value"), path), "mean", "variance")


@query("t1b_stream_bincount", """
    SELECT event_type, (props::JSON->>'$.k')::BIGINT AS bin, count(*) AS n FROM {events} GROUP BY ALL""")
def t1b(t):
    stream, _ = arriving(t, t.events, "events")
    bins = stream.groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return T.latest_per_key(bins, ["event_type", "bin"], scratch_path(t.spark, "stream-bincount"))


@query("t2_stream_merge", "WITH " + _PAIRS + " SELECT i, j, round(covar_samp(a, b), 9) AS covariance FROM pairs GROUP BY i, j")
def t2(t):
    stream, _ = arriving(t, t.embeddings, "vectors")
    merged = T.stream_moments(stream, "embedding", scratch_path(t.spark, "stream-moments"))
    return rounded(P.covariance(merged), "covariance", digits=9)


@query("t2b_stream_topk", """
    SELECT dim, vec_id, x, place FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY x DESC, vec_id)::INT AS place
      FROM (SELECT vec_id, (unnest(range(len(embedding))))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM {embeddings}) v) r WHERE place <= 10""")
def t2b(t):
    stream, _ = arriving(t, t.embeddings, "vectors")
    return T.stream_topk(stream, "embedding", "vec_id", 10, scratch_path(t.spark, "stream-topk"))


@query("t2c_stream_quantiles", _NEAR)
def t2c(t):
    stream, _ = arriving(t, t.embeddings, "vectors")
    return near_quantiles(t, K.state_quantiles(K.stream_quantiles(stream, "embedding", scratch_path(t.spark, "stream-quantiles")), 21))


@query("t3_stream_votes", "WITH " + _EVALUATED + """
    SELECT probe_id, n_votes, n_truth, knowledgable, majority_answer FROM evaluated WHERE n_votes > 0""")
def t3(t):
    stream, _ = arriving(t, t.votes, "votes")
    result = T.stream_votes(stream, scratch_path(t.spark, "stream-votes"))
    return result.select("probe_id", "n_votes", "n_truth", "knowledgable", "majority_answer")


@query("t4_stream_resume", """
    SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys, round(sum(value), 4) AS total FROM {events} GROUP BY event_type""")
def t4(t):
    # Every event arrives twice, half of the copies after a restart.
    stream, path = arriving(t, t.events, "events")
    sink = scratch_path(t.spark, "stream-once")
    T.append_once(stream, ["event_id"], sink)
    t.events.write.mode("append").parquet(path)
    again = t.spark.readStream.schema(t.events.schema).parquet(path)
    stored = T.append_once(again, ["event_id"], sink)
    return stored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_keys"), F.round(F.sum("value"), 4).alias("total")
    )


@query("t4b_stream_once_bounded", """
    SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_keys, round(sum(value), 4) AS total FROM {events} GROUP BY event_type""")
def t4b(t):
    # Every event arrives twice; the events span less than the delay, and keys older than that are forgotten.
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.unionByName(events)
    stream, _ = arriving(t, twice, "events")
    stored = T.append_once(stream, ["event_id"], scratch_path(t.spark, "stream-once"), late="60 days", event_time="ts")
    return stored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_keys"), F.round(F.sum("value"), 4).alias("total")
    )


@query("t5_stream_rates", """
    SELECT task, method, count(*) AS n, round(avg(hp::INT), 6) AS hp, round(avg(ap::INT), 6) AS ap, round(avg(fke::INT), 6) AS fke
    FROM {scored} GROUP BY task, method""")
def t5(t):
    items = t.items.select("item_id", "task", "method", "final_answer_correct")
    judged = nest(items, t.facts, ["knowledge", "knowledgable", "nli_class"], "required_knowledge")
    stream, _ = arriving(t, judged, "judged")
    rates = T.stream_rates(stream, ["task", "method"], scratch_path(t.spark, "stream-rates"))
    return rounded(rates, "hp", "ap", "fke")


def _shout():
    """A stand-in for a method: answers with the upper-cased part name."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(reply=batch["p_name"].str.upper(), words=batch["p_name"].str.split().str.len())

    return run


@query("u1_score", """
    SELECT flag, upper(p_name) AS reply, len(string_split(p_name, ' ')) AS words, count(*) AS n FROM {responses} GROUP BY ALL""")
def u1(t):
    scored = U.score(t.responses.select("flag", "p_name"), _shout, "flag string, p_name string, reply string, words bigint")
    return scored.groupBy("flag", "reply", "words").agg(F.count(F.lit(1)).alias("n"))


class MeanAndVariance:
    """Running mean and variance as (n, mean, sum of squared deviations)."""

    def __init__(self, column: str):
        self.column = column

    def partial(self, rows):
        values = rows[self.column].to_numpy()
        mean = float(values.mean())
        return len(values), mean, float(((values - mean) ** 2).sum())

    def merge(self, left, right):
        n = left[0] + right[0]
        delta = right[1] - left[1]
        return n, left[1] + delta * right[0] / n, left[2] + right[2] + delta * delta * left[0] * right[0] / n

    def dump(self, state):
        return struct.pack("<qdd", *state)

    def load(self, data):
        return struct.unpack("<qdd", data)

    def finish(self, state):
        n, mean, squares = state
        return {"n": n, "mean": mean, "variance": squares / (n - 1) if n > 1 else math.nan}


@query("u2_statistic", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM {events} GROUP BY event_type""")
def u2(t):
    statistic, by = MeanAndVariance("value"), ["event_type"]
    states = U.partial_states(t.events.select("event_type", "value"), statistic, by)
    merged = U.merge_states(states, statistic, by)
    return rounded(U.finish_states(merged, statistic, by, "n bigint, mean double, variance double"), "mean", "variance")


@query("u3_table_function", "WITH " + _CALLS_SQL + """
    SELECT library, function, count(*) AS n FROM called WHERE function IS NOT NULL GROUP BY library, function""")
def u3(t):
    U.register_functions(t.spark)
    expanded = t.spark.sql("SELECT c.cell, x.* FROM {cells} AS c, LATERAL library_calls(c.code) AS x", cells=cells(t))
    return expanded.filter("function is not null").groupBy("library", "function").agg(F.count(F.lit(1)).alias("n"))


@query("u4_judge_once", """
    SELECT answer, gt_answer, CASE WHEN ('0x' || substr(md5(concat_ws('|', answer, gt_answer)), 1, 8))::BIGINT % 2 = 0 THEN 'Yes, they agree.'
      ELSE 'No, they differ.' END AS verdict_text, count(*) AS n FROM {votes} GROUP BY ALL""")
def u4(t):
    requests = t.votes.select("probe_id", "answer", "gt_answer")
    judged = U.judge_once(requests, ["answer", "gt_answer"], U.stub_judge, "answer string, gt_answer string, verdict_text string")
    return judged.groupBy("answer", "gt_answer", "verdict_text").agg(F.count(F.lit(1)).alias("n"))


@query("u4b_judge_again", """
    SELECT verdict_text, count(*) AS n, count(DISTINCT (probe_id, answer)) AS requests,
      count(DISTINCT (probe_id, answer)) FILTER (WHERE probe_id % 3 <> 0) AS judged_now FROM (
      SELECT probe_id, answer, CASE WHEN ('0x' || substr(md5(concat_ws('|', probe_id, answer, gt_answer)), 1, 8))::BIGINT % 2 = 0 THEN 'Yes, they agree.'
        ELSE 'No, they differ.' END AS verdict_text FROM {votes}) v GROUP BY verdict_text""")
def u4b(t):
    """A run over a third of the probes, then one over all, which has only the other requests to judge."""
    path, key = scratch_path(t.spark, "verdicts"), ["probe_id", "answer", "gt_answer"]
    requests = t.votes.select(*key)
    schema = "probe_id bigint, answer string, gt_answer string, verdict_text string"
    judge_stored(requests.filter("probe_id % 3 = 0"), key, U.stub_judge, schema, path)
    first = A.committed_folders(t.spark, path)
    judged = judge_stored(requests, key, U.stub_judge, schema, path)
    second = [f"{path}/{f}" for f in A.committed_folders(t.spark, path) if f not in first]
    now = t.spark.read.parquet(*second).groupBy("verdict_text").agg(F.count(F.lit(1)).alias("judged_now"))
    counts = judged.groupBy("verdict_text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("probe_id", "answer").alias("requests"))
    return counts.join(now, "verdict_text", "left").withColumn("judged_now", F.coalesce("judged_now", F.lit(0)))
