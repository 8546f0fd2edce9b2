"""Statistics and retrieval of vectors against numpy."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorescope.operators import moments as P
from lorescope.operators import plugins as U
from lorescope.operators import retrieval as V
from lorescope.operators import stats as S
from lorescope.operators import verdicts as J
from lorescope.plans.stream_queries import MeanAndVariance
from lorescope.sources import records as A
from lorescope.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def frame(spark, data, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], f"id bigint, {name} array<double>").repartition(4)


def matrix(df, column):
    rows = df.collect()
    out = np.zeros((max(r["i"] for r in rows) + 1, max(r["j"] for r in rows) + 1))
    for r in rows:
        out[r["i"], r["j"]] = np.nan if r[column] is None else r[column]
    return out


def test_covariance_is_stable_far_from_zero(spark):
    data = np.random.default_rng(0).normal(size=(500, 6)) + 1e6
    merged = P.merge_moments(P.partial_moments(frame(spark, data), "v"))
    assert np.allclose(matrix(P.covariance(merged), "covariance"), np.cov(data.T), atol=1e-9)
    assert np.allclose(matrix(P.covariance(merged, unbiased=False), "covariance"), np.cov(data.T, bias=True), atol=1e-9)
    assert np.allclose(matrix(P.correlation(merged), "correlation"), np.corrcoef(data.T), atol=1e-9)
    assert np.allclose(matrix(P.second_moment(merged), "moment"), data.T @ data / 500, rtol=1e-12)


def test_states_merge_to_the_whole(spark):
    data = np.random.default_rng(1).normal(size=(300, 4))
    df = frame(spark, data)
    parts = P.partial_moments(df.filter("id < 100"), "v").unionByName(P.partial_moments(df.filter("id >= 100"), "v"))
    assert np.allclose(matrix(P.covariance(P.merge_moments(parts)), "covariance"), np.cov(data.T), atol=1e-12)
    overlaps = P.partial_overlaps(df.filter("id < 7"), "v").unionByName(P.partial_overlaps(df.filter("id >= 7"), "v"))
    positive = (data > 0).astype(int)
    assert (matrix(P.iou(overlaps), "intersection") == positive.T @ positive).all()


def test_divisibility_indicators(spark):
    n = np.arange(420)
    data = np.array([[float(x % k == 0) for k in (1, 2, 3, 4, 5)] + [float(x % k == 0) for k in (5, 6, 7)] for x in n])
    df = frame(spark, data).select("id", F.slice("v", 1, 5).alias("a"), F.slice("v", 6, 3).alias("b"))
    iou = matrix(P.iou(P.partial_overlaps(df, "a", "b")), "iou")
    assert abs(iou[4, 0] - 1) < 1e-12  # multiples of 5 against themselves
    lcm = len([x for x in n if x % 2 == 0 and x % 7 == 0])
    union = len([x for x in n if x % 2 == 0 or x % 7 == 0])
    assert abs(iou[1, 2] - lcm / union) < 1e-12
    cross = matrix(P.correlation(P.merge_moments(P.partial_moments(df, "a", "b")), undefined_as_zero=True), "correlation")
    assert (cross[0] == 0).all() and abs(cross[4, 0] - 1) < 1e-12


def test_vectors_of_different_length_are_refused(spark):
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0] * 3), (2, [1.0] * 5)]):
        df = spark.createDataFrame(rows, "id bigint, v array<double>").coalesce(1)
        with pytest.raises(Exception, match="different length"):
            P.partial_moments(df, "v").collect()
    gap = spark.createDataFrame([(1, [1.0, None])], "id bigint, v array<double>")
    with pytest.raises(Exception, match="a gap"):
        P.partial_moments(gap, "v").collect()


def test_merging_moves_one_row_per_task(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=(64, 5)))
    states = P.partial_moments(df, "v")
    assert states.count() <= df.rdd.getNumPartitions()
    plan = P.covariance(P.merge_moments(states))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_quantiles_leave_out_nulls(spark):
    rows = spark.createDataFrame([("g", float(i), i) for i in range(1, 6)] + [("g", None, 9)], "g string, x double, k int")
    found = {r["part"]: r["quantile"] for r in S.exact_quantiles(rows, "g", "x", "k", [0, 50, 100], 100).collect()}
    assert found == {0: 1.0, 50: 3.0, 100: 5.0}


def test_facts_with_placeholders_in_questions(spark):
    asked = spark.createDataFrame([(1, "why [F] and [Q]?", "FACT")], "k int, subquestion string, retrieved string")
    verdicts = spark.createDataFrame([(1, "yes")], "k int, verdict_text string")
    prompt = V.use_if_relevant(asked, verdicts, "k").first()["prompt"]
    assert prompt.startswith("Subquestion: why [F] and [Q]?\nRelevant Fact: FACT\n")


def test_judge_replies_to_null_requests(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "b")], "i int, x string, y string")
    out = U.judge_once(rows, ["x", "y"], U.stub_judge, "x string, y string, verdict_text string").collect()
    assert len(out) == 3 and all(r["verdict_text"] for r in out)


def test_whiten(spark):
    data = np.stack([r["embedding"] for r in table(spark, SMALL, "embeddings").orderBy("vec_id").collect()]).astype(float)
    inverse = np.linalg.inv(data.T @ data / len(data))
    want = data @ inverse.T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    vectors = table(spark, SMALL, "embeddings")
    moment = P.second_moment(P.merge_moments(P.partial_moments(vectors, "embedding")))
    got = np.stack([r["embedding"] for r in P.whiten(vectors, moment, "vec_id", "embedding").orderBy("vec_id").collect()])
    assert np.allclose(got, want, atol=1e-8)


def hazen(values, q):
    n = len(values)
    return np.interp(q, np.concatenate([[0], (np.arange(n) + 0.5) / n, [1]]), np.concatenate([[values.min()], np.sort(values), [values.max()]]))


@pytest.mark.parametrize("n", [1, 2, 37, 1000])
def test_exact_quantiles(spark, n):
    data = np.round(np.random.default_rng(n).normal(size=(n, 3)), 1)  # with ties
    long = S.long_vectors(frame(spark, data), "v", ["id"])
    for r in S.exact_quantiles(long, "dim", "x", "id", (0, 1, 10, 333, 500, 999, 1000), 1000).collect():
        assert abs(r["quantile"] - hazen(data[:, r["dim"]], r["part"] / 1000)) < 1e-9


def test_kll_error_and_extremes(spark):
    values = np.random.default_rng(3).permutation(50_000).astype(float)
    long = spark.createDataFrame([(0, float(v)) for v in values], "dim int, x double")
    for r in S.kll_quantiles(long, "dim", "x", [0, 0.1, 0.5, 0.9, 1]).collect():
        assert abs(r["value"] / 50_000 - r["quantile"]) < (1e-3 if 0 < r["quantile"] < 1 else 1e-4)
        assert r["n"] == 50_000
    edges = {r["quantile"]: r["value"] for r in S.kll_quantiles(long, "dim", "x", [0, 1]).collect()}
    assert edges == {0.0: 0.0, 1.0: 49_999.0}


def test_normalize_follows_interpolation(spark):
    data = np.random.default_rng(5).normal(size=(200, 2))
    df = frame(spark, data)
    normed = S.quantile_normalize(df, "v", "id", S.readout(df, "v", "id", 101), 101)
    got = np.stack([r["v"] for r in normed.orderBy("id").collect()])
    levels = np.arange(101) / 100
    for d in range(2):
        assert np.allclose(got[:, d], np.interp(data[:, d], hazen(data[:, d], levels), levels), atol=1e-9)


def test_topk_ties_go_to_the_first_row(spark):
    df = spark.createDataFrame([(i, [float(i % 3)]) for i in range(9)], "id bigint, v array<double>")
    assert [(r["id"], r["x"]) for r in S.topk(df, "v", "id", 4).orderBy("place").collect()] == [(2, 2.0), (5, 2.0), (8, 2.0), (1, 1.0)]
    assert [r["id"] for r in S.topk(df, "v", "id", 2, largest=False).orderBy("place").collect()] == [0, 3]


def test_bincount_fills_gaps(spark):
    df = spark.createDataFrame([(0,), (3,), (3,), (None,)], "k int")
    assert sorted(tuple(r) for r in S.bincount(df, "k").collect()) == [(0, 1), (1, 0), (2, 0), (3, 2)]
    assert S.bincount(df.filter("k > 9"), "k").count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_retrieve_in_groups(spark, block):
    rng = np.random.default_rng(6)
    q = [(i, "hot" if i % 3 else f"g{i}", [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    f = [(i, "hot" if i % 3 else f"g{i}", [float(x) for x in rng.normal(size=5)]) for i in range(90)]
    queries = spark.createDataFrame(q, "query_id bigint, scope string, embedding array<double>")
    facts = spark.createDataFrame(f, "fact_id bigint, scope string, embedding array<double>")
    got = {(r["query_id"], r["place"]): r["fact_id"] for r in V.retrieve(queries, facts, 3, ["scope"], block=block).collect()}
    want = {}
    for i, g, a in q:
        ranked = sorted((-round(float(np.dot(a, b)), 9), j) for j, h, b in f if h == g)
        want.update({(i, p + 1): j for p, (_, j) in enumerate(ranked[:3])})
    assert got == want


def test_retrieve_best_without_candidates(spark):
    queries = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "query_id bigint, scope string, embedding array<double>")
    facts = spark.createDataFrame([(7, "a", [2.0], "text")], "fact_id bigint, scope string, embedding array<double>, text string")
    out = V.retrieve_best(queries, facts, ["scope"], "text")
    assert {r["query_id"]: r["retrieved"] for r in out.collect()} == {1: "text", 2: ""}


def test_statistic_states_flush_and_merge(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 20, 2000), rng.normal(size=2000) + 1e4)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(6)
    statistic = MeanAndVariance("x")
    states = U.partial_states(df, statistic, ["k"], held=3)
    out = U.finish_states(U.merge_states(states, statistic, ["k"], fan_in=2), statistic, ["k"], "n bigint, mean double, variance double")
    for r in out.collect():
        values = np.array([v for k, v in rows if k == r["k"]])
        assert r["n"] == len(values) and abs(r["mean"] - values.mean()) < 1e-8 and abs(r["variance"] - values.var(ddof=1)) < 1e-8


def test_judge_sees_each_request_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def run(batch):
            seen.add(len(batch))
            return batch.assign(verdict_text="Yes")
        return run

    requests = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3, "answer string")
    assert U.judge_once(requests, ["answer"], make, "answer string, verdict_text string").filter("verdict_text = 'Yes'").count() == 53
    assert seen.value == 2


def test_states_of_quantiles_merge(spark):
    """Sketches of uneven parts, merged in two steps, keep ranks within the bound; extremes are exact."""
    from lorescope.operators import sketches as K

    draw = np.random.default_rng(3)
    data = np.concatenate([draw.normal(size=30_000), draw.exponential(size=20_000) * 5, np.full(5_000, 1.25)])
    part = np.minimum(draw.geometric(0.3, len(data)), 6)
    rows = spark.createDataFrame([(int(p), [float(x), float(-x)]) for p, x in zip(part, data)] + [(1, None), (2, [float("nan"), None])], "p int, v array<double>")
    states = K.quantile_states(rows, "v", ["p"])
    halves = [K.merge_quantile_states(states.filter(c)) for c in ("p <= 2", "p > 2")]
    merged = K.merge_quantile_states(halves[0].unionByName(halves[1]))
    assert [r["n"] for r in merged.collect()] == [len(data)] * 2
    for r in K.state_quantiles(merged, 101).collect():
        values = np.sort(data if r["dim"] == 0 else -data)
        low, high = np.searchsorted(values, r["quantile"], "left"), np.searchsorted(values, r["quantile"], "right")
        room = K.ERROR * len(data) + 1
        assert low <= r["part"] / 100 * len(data) + room and high >= r["part"] / 100 * len(data) - room
        if r["part"] in (0, 100):
            assert r["quantile"] == values[0 if r["part"] == 0 else -1]
    asked = K.state_ranks(merged, [-99.0, 0.0, 1.25, 4.0, 1e9]).filter("dim = 0").collect()
    assert len(asked) == 5 and all(abs(r["rank"] - (data <= r["value"]).mean()) <= K.ERROR + 1e-9 for r in asked)
    assert "Sort" not in K.state_quantiles(merged, 101)._jdf.queryExecution().executedPlan().toString().replace("SortAggregate", "")


def test_a_symmetric_state_is_a_triangle(spark):
    data = np.random.default_rng(4).normal(size=(300, 6)) + 5
    state = P.merge_states(P.partial_moments(frame(spark, data), "v"))
    row = state.first()
    assert len(row["comoment"]) == 8 * 21
    assert np.allclose(P.state_moment(state), data.T @ data / 300)
    both = P.partial_moments(frame(spark, data), "v").limit(1).first()
    assert len(both["comoment"]) == 8 * 21


def test_bincount_refuses_what_is_not_dense(spark):
    rows = spark.createDataFrame([(3,), (10**12,), (3,), (None,)], "v bigint")
    with pytest.raises(ValueError):
        S.bincount(rows, "v")
    with pytest.raises(ValueError):
        S.bincount(spark.createDataFrame([(-1,), (2,)], "v bigint"), "v")
    assert sorted(map(tuple, S.sparse_bincount(rows, "v").collect())) == [(3, 2, 10**12 - 4), (10**12, 1, 0)]


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_retrieval_by_norms_is_exact_and_leaves_blocks_out(spark, spread):
    """All top lists by brute force; with skewed norms under half of the pairs of queries and facts are multiplied."""
    draw = np.random.default_rng(8)
    facts = draw.normal(size=(900, 8)) * np.exp(spread * draw.normal(size=(900, 1)))
    facts[17], facts[400] = 0, facts[3]
    queries = np.concatenate([draw.normal(size=(60, 8)), -facts[:3], np.zeros((1, 8))])
    f = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(facts)], "fact_id int, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id int, embedding array<double>")
    scores = np.round(queries @ facts.T, 9) + 0.0
    want = {i: sorted(range(900), key=lambda j: (-row[j], j))[:5] for i, row in enumerate(scores)}
    got = {}
    for r in V.retrieve(q, f, 5, block=32).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["fact_id"])
    assert got == want
    if spread:
        _, left, right, _ = V.norm_plan(q, f, 5, block=32)
        cells = left.groupBy("_q", "_f").count().join(right.groupBy("_q", "_f").agg(F.count("fact_id").alias("n")), ["_q", "_f"])
        assert cells.agg(F.sum(F.col("count") * F.col("n"))).first()[0] + 64 * 32 < 64 * 900 / 2
    few = V.retrieve(q, f.limit(3), 5).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {3} and V.retrieve(q.limit(0), f, 5).count() == V.retrieve(q, f.limit(0), 5).count() == 0


def counted():
    """A count whose states know how many were alive in their process at once. Defined here to reach tasks by value."""

    class Held:
        alive = peak = 0

        def __init__(self, n, peak=0):
            self.n = n
            Held.alive += 1
            Held.peak = max(Held.peak, Held.alive, peak)

        def __del__(self):
            Held.alive -= 1

    class Counted:
        def partial(self, rows):
            return Held(len(rows))

        def merge(self, left, right):
            return Held(left.n + right.n)

        def dump(self, state):
            return struct.pack("<qq", state.n, Held.peak)

        def load(self, data):
            return Held(*struct.unpack("<qq", data))

        def finish(self, state):
            return {"n": state.n, "peak": Held.peak}

    return Counted()


def test_merge_tree_holds_one_state_at_a_time(spark):
    """10,000 equal states of one key, few of others, NULL and NaN among the keys."""
    one, statistic = struct.pack("<qq", 1, 0), counted()
    nan, missing = float("nan"), None
    keys = [(1.0, "hot")] * 10_000 + [(nan, "x")] * 70 + [(missing, "x")] * 65 + [(missing, None)] * 3 + [(0.0, "y"), (-0.0, "y")]
    states = spark.createDataFrame([(*k, one) for k in keys], "`a b` double, k string, state binary").repartition(7)
    merged = U.merge_states(states.withColumnRenamed("a b", "a"), statistic, ["a", "k"], fan_in=16)
    out = U.finish_states(merged, statistic, ["a", "k"], "n bigint, peak bigint").collect()
    found = {(str(r["a"] and r["a"] + 0.0) if r["a"] != 0 else "0.0", r["k"]): r["n"] for r in out}
    assert found == {("1.0", "hot"): 10_000, ("nan", "x"): 70, ("None", "x"): 65, ("None", None): 3, ("0.0", "y"): 2} and len(out) == 5
    assert max(r["peak"] for r in out) <= 4  # the sum, the next state, their sum and the last one finished
    assert U.merge_states(states.limit(0), statistic, ["a b", "k"]).count() == 0


def counting_judge(seen):
    def make():
        def run(batch):
            seen.add(len(batch))
            return batch.assign(verdict=batch["q"].fillna("none") + "!")
        return run

    return make


def test_verdicts_are_kept_between_runs(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "q string, k int, verdict string"
    seen = spark.sparkContext.accumulator(0)
    make = counting_judge(seen)

    def asked(rows):
        return spark.createDataFrame(rows, "id int, q string, k int")

    first = [(i, f"q{i % 40}", 1) for i in range(200)] + [(900, None, 1), (901, None, None), (902, "q1", None)]
    out = J.judge_stored(asked(first), ["q", "k"], make, schema, path).collect()
    assert len(out) == 203 and seen.value == 43 and all(r["verdict"] == (r["q"] or "none") + "!" for r in out)
    second = first + [(i, f"q{i}", 2) for i in range(5000, 5300)]
    out = J.judge_stored(asked(second), ["q", "k"], make, schema, path).collect()
    assert len(out) == 503 and seen.value == 343 and all(r["verdict"] == (r["q"] or "none") + "!" for r in out)
    J.judge_stored(asked(second), ["q", "k"], make, schema, path).count()
    J.judge_stored(asked([]), ["q", "k"], make, schema, path).count()
    assert seen.value == 343 and len(A.committed_folders(spark, path)) == 2


def test_key_filter_grows_and_misses_no_key(spark, tmp_path):
    path = str(tmp_path / "v")
    for start, end in ((0, 300), (300, 9000), (9000, 9100)):
        A.append_results(spark.range(start, end).withColumn("v", F.lit("x")), path, ["id"])
        folders = A.committed_folders(spark, path)
        filter_ = J.key_filter(spark, path, ["id"], folders)
        marked = J.maybe_known(spark.range(0, 40_000), filter_, ["id"])
        assert marked.filter(f"id < {end} and not maybe").count() == 0
        assert marked.filter(f"id >= {end} and maybe").count() < 0.05 * (40_000 - end)
    words = [r["words"] for r in filter_.select("words").distinct().collect()]
    assert words == [8192] and filter_.first()["keys"] == 9100  # twice the room when built anew, then only added to
    # A filter that a dead run left without its end, or that covers less, misses nothing either.
    assert [n for n, _ in J._stored_filters(spark, path)] == [1, 2, 3]
    (tmp_path / "v" / "_filters" / "000000000009-dead").mkdir()
    again = J.key_filter(spark, path, ["id"], folders)
    assert J.maybe_known(spark.range(9100), again, ["id"]).filter("not maybe").count() == 0
