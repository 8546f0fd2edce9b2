"""Statistics and retrieval over the embeddings, and counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import moments as P
from lorescope.operators import retrieval as V
from lorescope.operators import sketches as K
from lorescope.operators import stats as S
from lorescope.operators.ordering import dense_index
from lorescope.operators.reshape import scope_groups
from lorescope.plans.metric_queries import rounded
from lorescope.plans.registry import Inputs, query
from lorescope.plans.reshape_queries import SCOPES
from lorescope.plans.text_queries import checksum, sql_checksum
from lorescope.session import scratch_path

_LONG = """vals AS (SELECT vec_id, label, (unnest(range(len(embedding))))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM {embeddings})"""
_HALVES = _LONG + """, lefts AS (SELECT vec_id, dim AS i, x AS a FROM vals WHERE dim < 32), rights AS (SELECT vec_id, dim - 32 AS j, x AS b FROM vals WHERE dim >= 32)"""
_PAIRS = _LONG + """, pairs AS (SELECT p.dim AS i, q.dim AS j, p.x AS a, q.x AS b FROM vals p JOIN vals q USING (vec_id))"""


def halves(t: Inputs) -> DataFrame:
    half = F.floor(F.size("embedding") / 2).cast("int")
    return t.embeddings.select(
        F.slice("embedding", F.lit(1), half).alias("left"), F.slice("embedding", half + 1, half).alias("right")
    )


@query("s1_mean", "WITH " + _LONG + " SELECT dim, count(*) AS n, round(avg(x), 9) AS mean FROM vals GROUP BY dim")
def s1(t):
    return rounded(S.vec_mean(t.embeddings, "embedding"), "mean", digits=9)


@query("s2_norm_mean", "SELECT label, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS norm_mean FROM {embeddings} GROUP BY label")
def s2(t):
    return rounded(S.norm_mean(t.embeddings, "embedding", ["label"]), "norm_mean", digits=9)


@query("s3_variance", "WITH " + _LONG + """
    SELECT dim, round(avg(x), 9) AS mean, round(var_samp(x), 9) AS variance, round(var_pop(x), 9) AS variance_biased,
      round(stddev_samp(x), 9) AS stdev, round(stddev_pop(x), 9) AS stdev_biased FROM vals GROUP BY dim""")
def s3(t):
    return rounded(S.vec_variance(t.embeddings, "embedding"), "mean", "variance", "variance_biased", "stdev", "stdev_biased", digits=9)


def merged(t: Inputs) -> DataFrame:
    return P.merge_moments(P.partial_moments(t.embeddings, "embedding"))


@query("s4_cov", "WITH " + _PAIRS + " SELECT i, j, round(covar_samp(a, b), 9) AS covariance FROM pairs GROUP BY i, j")
def s4(t):
    return rounded(P.covariance(merged(t)), "covariance", digits=9)


@query("s5_corr", "WITH " + _PAIRS + " SELECT i, j, round(corr(a, b), 9) AS correlation FROM pairs GROUP BY i, j")
def s5(t):
    return rounded(P.correlation(merged(t)), "correlation", digits=9)


@query("s6_mom2", "WITH " + _PAIRS + " SELECT i, j, round(avg(a * b), 9) AS moment FROM pairs GROUP BY i, j")
def s6(t):
    return rounded(P.second_moment(merged(t)), "moment", digits=9)


@query("s7_bincount", """
    WITH counts AS (SELECT (props::JSON->>'$.k')::BIGINT AS bin, count(*) AS n FROM {events} GROUP BY 1)
    SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT max(bin) + 1 FROM counts))) AS bin) b LEFT JOIN counts c ON b.bin = c.bin""")
def s7(t):
    return S.bincount(t.events.select(F.get_json_object("props", "$.k").cast("bigint").alias("k")), "k")


@query("s8_xcov", "WITH " + _HALVES + """
    SELECT i, j, round(covar_samp(a, b), 9) AS covariance, coalesce(round(corr(a, b), 9), 0) AS correlation FROM lefts JOIN rights USING (vec_id) GROUP BY i, j""")
def s8(t):
    state = P.merge_moments(P.partial_moments(halves(t), "left", "right"))
    both = P.covariance(state).join(P.correlation(state, undefined_as_zero=True), ["i", "j"])
    return rounded(both, "covariance", "correlation", digits=9)


_IOU = """SELECT i, j, count(*) FILTER (WHERE a > 0 AND b > 0) AS intersection, count(*) FILTER (WHERE a > 0 OR b > 0) AS "union",
      round(count(*) FILTER (WHERE a > 0 AND b > 0) / (count(*) FILTER (WHERE a > 0 OR b > 0) + 1e-20), 9) AS iou"""


@query("s9_iou", "WITH " + _PAIRS + _IOU + " FROM pairs GROUP BY i, j")
def s9(t):
    return rounded(P.iou(P.partial_overlaps(t.embeddings, "embedding")), "iou", digits=9)


@query("s10_xiou", "WITH " + _HALVES + _IOU + " FROM lefts JOIN rights USING (vec_id) GROUP BY i, j")
def s10(t):
    return rounded(P.iou(P.partial_overlaps(halves(t), "left", "right")), "iou", digits=9)


def _quantile_sql(of: int, parts: str) -> str:
    return f"""ranked AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x, vec_id) AS r, count(*) OVER (PARTITION BY dim) AS n FROM vals),
    wanted AS (SELECT DISTINCT dim, n, part::BIGINT AS part, 2 * part * n + {of} AS scaled FROM ranked, ({parts}) p(part)),
    placed AS (SELECT dim, part, least(greatest(scaled // {2 * of}, 1), n) AS lo, least(greatest(scaled // {2 * of} + 1, 1), n) AS hi, (scaled % {2 * of}) / {2 * of}.0::DOUBLE AS frac FROM wanted),
    readout AS (SELECT p.dim, part, a.x + (b.x - a.x) * frac AS quantile FROM placed p JOIN ranked a ON a.dim = p.dim AND a.r = lo JOIN ranked b ON b.dim = p.dim AND b.r = hi)"""


QUANTILES = (0, 5, 25, 50, 75, 95, 100)


@query("s11_quantiles", "WITH " + _LONG + ", " + _quantile_sql(100, "VALUES " + ", ".join(f"({q})" for q in QUANTILES)) + """
    SELECT dim, part, round(quantile, 9) AS quantile FROM readout""")
def s11(t):
    long = S.long_vectors(t.embeddings, "embedding", ["vec_id"])
    return rounded(S.exact_quantiles(long, "dim", "x", "vec_id", QUANTILES, 100), "quantile", digits=9)


# A value's ranks must come within the error bound of its quantile; a sketch of 3072 keeps below this share of n.
KLL_ERROR = 0.002


@query("s11b_kll", "WITH " + _LONG + """
    SELECT DISTINCT dim, part, count(*) OVER (PARTITION BY dim, part) AS n, true AS near FROM vals, (VALUES """ + ", ".join(f"({q})" for q in QUANTILES) + """) p(part)""")
def s11b(t):
    long = S.long_vectors(t.embeddings, "embedding")
    found = S.kll_quantiles(long, "dim", "x", [q / 100 for q in QUANTILES]).select("dim", "quantile", "value")
    # Seven values per dimension meet the dimension's rows.
    ranks = long.join(found, "dim").groupBy("dim", "quantile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto")
    )
    room = KLL_ERROR * F.col("n") + 1
    wanted = F.col("quantile") * F.col("n")
    near = (F.col("below") <= wanted + room) & (F.col("upto") >= wanted - room)
    return ranks.select("dim", F.round(F.col("quantile") * 100).cast("int").alias("part"), "n", near.alias("near"))


_READOUT = "WITH " + _LONG + ", " + _quantile_sql(1000, "SELECT unnest(range(1001))")


@query("s12_readout", _READOUT + " SELECT dim, part, round(quantile, 9) AS quantile FROM readout")
def s12(t):
    return rounded(S.readout(t.embeddings, "embedding", "vec_id"), "quantile", digits=9)


@query("s13_qnorm", _READOUT + """,
    steps AS (SELECT dim, part, quantile AS q, lead(quantile) OVER (PARTITION BY dim ORDER BY part) AS q_next FROM readout),
    found AS (SELECT v.vec_id, v.dim, v.x, max(part) AS part FROM vals v JOIN steps s ON v.dim = s.dim AND s.q <= v.x GROUP BY v.vec_id, v.dim, v.x)
    SELECT f.vec_id, f.dim, round(CASE WHEN f.part = 1000 THEN 1 ELSE f.part / 1000 + (f.x - q) / (q_next - q) / 1000 END, 9) AS level
    FROM found f JOIN steps s ON f.dim = s.dim AND f.part = s.part""")
def s13(t):
    normed = S.quantile_normalize(t.embeddings, "embedding", "vec_id", S.readout(t.embeddings, "embedding", "vec_id"))
    return rounded(S.long_vectors(normed, "embedding", ["vec_id"]).withColumnRenamed("x", "level"), "level", digits=9)


def near_quantiles(t: Inputs, read: DataFrame) -> DataFrame:
    """Whether each quantile read from a state (dim, part of 20, quantile, n) has its rank; 21 values a dimension meet its rows."""
    long = S.long_vectors(t.embeddings, "embedding")
    ranks = long.join(read, "dim").groupBy("dim", "part", "n", "quantile").agg(
        F.count_if(F.col("x") < F.col("quantile")).alias("below"), F.count_if(F.col("x") <= F.col("quantile")).alias("upto"))
    return ranks.select("dim", "part", "n", K.near(F.col("quantile"), F.col("part") / 20, F.col("n"), F.col("below"), F.col("upto")).alias("near"))


_NEAR = "WITH " + _LONG + " SELECT dim, part::INT AS part, n, true AS near FROM (SELECT dim, count(*) AS n FROM vals GROUP BY dim) d, (SELECT unnest(range(21)) AS part) p"


@query("s12b_readout_sketch", _NEAR)
def s12b(t):
    # States of four days, stored, read again under their arguments and merged; ranks within K.ERROR, no total sort.
    path, days = scratch_path(t.spark, "quantile-states"), t.embeddings.withColumn("day", F.col("vec_id") % 4)
    states = S.tally(t.spark, path, {"what": "quantiles", "k": K.K}, lambda: K.quantile_states(days, "embedding", ["day"]))
    return near_quantiles(t, K.state_quantiles(K.merge_quantile_states(states), 21))


@query("s13b_qnorm_sketch", _NEAR)
def s13b(t):
    # Levels read from the states are even: a share p of the values, within the error, has a level of at most p.
    normed = K.sketch_normalize(t.embeddings, "embedding", "vec_id", K.quantile_states(t.embeddings, "embedding"))
    long, part = S.long_vectors(normed, "embedding"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("part")
    counts = long.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("x") < p / 20).alias(f"below{p}") for p in range(21)], *[F.count_if(F.col("x") <= p / 20).alias(f"upto{p}") for p in range(21)])
    at = counts.select("*", part)
    pick = lambda name: F.get(F.array(*[F.col(f"{name}{p}") for p in range(21)]), F.col("part"))
    return at.select("dim", "part", "n", K.near(F.lit(0.0), F.col("part") / 20, F.col("n"), pick("below"), pick("upto")).alias("near"))


@query("s14_integrate", "WITH " + _LONG + """
    SELECT dim, count(*)::DOUBLE AS count, round(sum(x), 9) AS total, round(sum(x * x), 9) AS squares, round(sum(abs(x)), 9) AS absolute FROM vals GROUP BY dim""")
def s14(t):
    functions = {"count": lambda x: F.lit(1.0), "total": lambda x: x, "squares": lambda x: x * x, "absolute": F.abs}
    return rounded(S.integrate(t.embeddings, "embedding", functions), "total", "squares", "absolute", digits=9)


@query("s15_topk", "WITH " + _LONG + """
    SELECT 'largest' AS side, dim, vec_id, x, place FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY x DESC, vec_id)::INT AS place FROM vals) a WHERE place <= 10
    UNION ALL SELECT 'smallest', dim, vec_id, x, place FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY x, vec_id)::INT AS place FROM vals) b WHERE place <= 10""")
def s15(t):
    sides = [S.topk(t.embeddings, "embedding", "vec_id", 10, largest=big).withColumn("side", F.lit(name)) for big, name in ((True, "largest"), (False, "smallest"))]
    return sides[0].unionByName(sides[1])


@query("s16_history", "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS place, event_id, value FROM {events}")
def s16(t):
    return S.history(t.events, ["ts", "event_id"], ["event_id", "value"])


@query("s17_combined", """
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance, min(value) AS low, max(value) AS high,
      max((props::JSON->>'$.k')::BIGINT) AS top_k FROM {events} GROUP BY event_type""")
def s17(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    both = S.combined(t.events, {
        "n": F.count(F.lit(1)), "mean": F.avg("value"), "variance": F.var_samp("value"), "low": F.min("value"),
        "high": F.max("value"), "top_k": F.max(k),
    }, ["event_type"])
    return rounded(both, "mean", "variance")


@query("s18_tally", "WITH " + _PAIRS + " SELECT i, j, round(covar_samp(a, b), 9) AS covariance FROM pairs GROUP BY i, j")
def s18(t):
    path, args = scratch_path(t.spark, "tally"), {"stat": "moments", "column": "embedding", "sample_size": "all"}

    def state() -> DataFrame:
        return S.tally(t.spark, path, args, lambda: P.partial_moments(t.embeddings, "embedding"))

    state()
    return rounded(P.covariance(P.merge_moments(state())), "covariance", digits=9)


@query("s19_bernoulli", """
    SELECT doc_id, lang FROM {documents} WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT < 288230376151711744""")
def s19(t):
    return S.sample_portion(t.documents, "doc_id", 0.25).select("doc_id", "lang")


@query("s20_whiten", """
    SELECT vec_id, 1.0::DOUBLE AS length, 1.0::DOUBLE AS cosine FROM {embeddings}""")
def s20(t):
    # What the moment makes of a turned vector must point where the vector points.
    moment = P.state_moment(P.merge_states(P.partial_moments(t.embeddings, "embedding")))
    turned = P.whiten(t.embeddings, moment, "vec_id", "embedding")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    back = P.multiplied(turned, moment, "vec_id", "embedding").withColumnRenamed("embedding", "back")
    back = back.join(turned.withColumnRenamed("embedding", "turned"), "vec_id").join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    cosine = dot(F.col("back"), F.col("embedding")) / (S.l2_norm(F.col("back")) * S.l2_norm(F.col("embedding")))
    return rounded(back.select("vec_id", S.l2_norm(F.col("turned")).alias("length"), cosine.alias("cosine")), "length", "cosine", digits=9)


_POOLED = _LONG + """, firsts AS (SELECT vec_id, x > 0 AS attended FROM vals WHERE dim = 0),
    pooled AS (SELECT label, dim, avg(x) AS mean FROM vals JOIN firsts USING (vec_id) WHERE attended GROUP BY label, dim)"""


def pooled(t: Inputs) -> DataFrame:
    return V.masked_mean_pool(t.embeddings, "label", "embedding", F.get("embedding", F.lit(0)) > 0)


@query("v1_pool", "WITH " + _POOLED + " SELECT label, dim, round(mean, 9) AS mean FROM pooled")
def v1(t):
    return rounded(S.long_vectors(pooled(t), "embedding", ["label"]).withColumnRenamed("x", "mean"), "mean", digits=9)


@query("v2_knn_dot", "WITH " + _POOLED + """,
    queries AS (SELECT label, list(mean ORDER BY dim) AS q FROM pooled GROUP BY label),
    scored AS (SELECT q.label AS query_id, vec_id AS fact_id, round(list_inner_product(q, embedding::DOUBLE[]), 9) AS score FROM queries q, {embeddings} e)
    SELECT query_id, fact_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id)::INT AS place FROM scored) x WHERE place <= 10""")
def v2(t):
    queries = pooled(t).withColumnRenamed("label", "query_id")
    facts = t.embeddings.select(F.col("vec_id").alias("fact_id"), "embedding")
    return rounded(V.retrieve(queries, facts, 10), "score")


@query("v3_knn_scoped", """
    WITH grouped AS (SELECT idx // scope AS group_id, scope, vec_id, label, embedding::DOUBLE[] AS e
      FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM {embeddings}) x, (VALUES (1), (10), (100), (500)) s(scope)),
    scored AS (SELECT q.scope, q.vec_id, f.vec_id AS fact_id, f.label, round(list_inner_product(q.e, f.e), 9) AS score
      FROM grouped q JOIN grouped f ON q.scope = f.scope AND q.group_id = f.group_id AND f.e[1] > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY scope, vec_id ORDER BY score DESC, fact_id) AS rn FROM scored)
    SELECT g.scope, g.vec_id, b.fact_id, round(score, 6) AS score, CASE WHEN b.fact_id IS NULL THEN '' ELSE concat('label ', b.label) END AS retrieved
    FROM grouped g LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON g.scope = b.scope AND g.vec_id = b.vec_id""")
def v3(t):
    grouped = scope_groups(dense_index(t.embeddings, ["vec_id"], "idx"), SCOPES)
    queries = grouped.select(F.struct("scope", "vec_id").alias("query_id"), "scope", "group_id", "embedding")
    queries = queries.withColumn("query_id", F.concat_ws("|", "query_id.scope", "query_id.vec_id"))
    known = grouped.filter(F.get("embedding", F.lit(0)) > 0)
    facts = known.select(F.col("vec_id").alias("fact_id"), "scope", "group_id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    best = V.retrieve_best(queries, facts, ["scope", "group_id"], "text")
    return rounded(best, "score").select(
        "scope", F.split("query_id", "[|]")[1].cast("bigint").alias("vec_id"), "fact_id", "score", "retrieved"
    )


@query("v4_relevant", f"""
    WITH asked AS (SELECT concat('What is ', p_type, '?') AS q, CASE WHEN answer = 'O' THEN p_name ELSE '' END AS f, flag, contains(lower(verdict_text), 'yes') AND answer = 'O' AS relevant FROM {{responses}}),
    prompts AS (SELECT flag, relevant, CASE WHEN relevant THEN concat('Subquestion: ', q, chr(10), 'Relevant Fact: ', f, chr(10), chr(10), 'From the provided fact, answer the given subquestion as concisely as possible.', chr(10), 'Answer:')
      ELSE concat('Subquestion: ', q, chr(10), chr(10), 'Answer the given subquestion as concisely as possible.', chr(10), 'Answer:') END AS prompt FROM asked)
    SELECT flag, relevant, count(*) AS n, {sql_checksum('prompt')} AS digest FROM prompts GROUP BY flag, relevant""")
def v4(t):
    # The judge is asked once per fact and flag, which is what its reply depends on.
    rows = t.responses.withColumn("request", F.concat_ws("|", "flag", "p_name"))
    asked = rows.select(
        "request", "flag", F.concat(F.lit("What is "), "p_type", F.lit("?")).alias("subquestion"),
        F.when(F.col("answer") == "O", F.col("p_name")).otherwise("").alias("retrieved"),
    )
    verdicts = rows.groupBy("request").agg(F.min("verdict_text").alias("verdict_text"))
    return V.use_if_relevant(asked, verdicts, "request").groupBy("flag", "relevant").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.col("prompt")).alias("digest")
    )
