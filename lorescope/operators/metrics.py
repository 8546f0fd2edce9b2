"""Run metrics: answer pass (AP), full knowledge entailment (FKE), holistic pass (HP)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.functions.hashing import hash60
from lorescope.functions.text import one_decimal, word_count

METRICS = ("hp", "ap", "fke")
RUN_KEY = ("task", "model", "method", "scope")


def answer_pass(correct: Column) -> Column:
    return F.coalesce(correct, F.lit(False))


def facts_entailed(required_knowledge: Column) -> Column:
    """All facts of a nested item are entailed: true when empty, false when missing."""
    return F.coalesce(
        F.forall(required_knowledge, lambda k: F.coalesce(k["nli_class"] == "entailment", F.lit(False))),
        F.lit(False),
    )


def score_items(items: DataFrame, facts: DataFrame, key: str = "item_id") -> DataFrame:
    """Add ap, fke and hp to flat items; an item without facts counts as entailed."""
    entailed = facts.groupBy(key).agg(
        F.bool_and(F.coalesce(F.col("nli_class") == "entailment", F.lit(False))).alias("_entailed")
    )
    return (
        items.join(entailed, key, "left")
        .withColumn("ap", answer_pass(F.col("final_answer_correct")))
        .withColumn("fke", F.coalesce("_entailed", F.lit(True)))
        .withColumn("hp", F.col("ap") & F.col("fke"))
        .drop("_entailed")
    )


def cell_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per run key: n and the four counts of AP x FKE. Every rate derives from these."""
    ap, fke = F.col("ap"), F.col("fke")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ap & fke).alias("both"),
        F.count_if(ap & ~fke).alias("ap_only"),
        F.count_if(~ap & fke).alias("fke_only"),
        F.count_if(~ap & ~fke).alias("neither"),
    )


def rates(cells: DataFrame) -> DataFrame:
    """hp, ap and fke rates from the cell counts."""
    n = F.col("n")
    return cells.select(
        *[c for c in cells.columns if c not in ("both", "ap_only", "fke_only", "neither")],
        (F.col("both") / n).alias("hp"),
        ((F.col("both") + F.col("ap_only")) / n).alias("ap"),
        ((F.col("both") + F.col("fke_only")) / n).alias("fke"),
    )


def long_rates(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per run key and metric, in percent."""
    return rates(cells).unpivot(list(by), list(METRICS), "metric", "rate").withColumn("rate", F.col("rate") * 100)


def _summary(percentiles: DataFrame) -> DataFrame:
    return percentiles.withColumn("midpoint", (F.col("lower") + F.col("upper")) / 2).withColumn(
        "margin", (F.col("upper") - F.col("lower")) / 2
    )


def _log_gamma(x: str) -> str:
    """SQL for ln of the gamma function, by Stirling's series ten places up; both engines have what it uses."""
    up = f"({x} + 10)"
    steps = " * ".join(f"({x} + {i})" for i in range(10))
    series = f"1 / (12 * {up}) - 1 / (360 * pow({up}, 3)) + 1 / (1260 * pow({up}, 5))"
    return f"(({up} - 0.5) * ln({up}) - {up} + 0.9189385332046727e0 + {series} - ln({steps}))"


def binomial_sql(n: str, k: str, p: str) -> str:
    """SQL for the probability of k hits in n draws, 0 < p < 1; arguments are names of doubles."""
    ways = f"{_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({k} + 1)')} - {_log_gamma(f'({n} - {k} + 1)')}"
    return f"exp({ways} + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def interval_places(replicates: int) -> list[tuple[int, int, float]]:
    """Lower and higher place and the share of the higher one, for the 2.5th and 97.5th percentile of sorted draws."""
    at = [(replicates - 1) * q for q in (0.025, 0.975)]
    return [(int(x), min(int(x) + 1, replicates - 1), x - int(x)) for x in at]


def bootstrap_hashed(cells: DataFrame, by: Sequence[str], replicates: int = 1000) -> DataFrame:
    """Percentile bootstrap with hashed draws, reproducible in any SQL engine.

    The hits of a replicate, n draws with replacement, are binomial. A hashed
    uniform per replicate is turned into hits by the inverse of that
    distribution; as it is monotone, only the uniforms next to the two
    percentiles are. The distribution is summed over twelve standard deviations
    around the mean, so a run costs ``replicates`` hashes and about the root of
    n numbers per metric.
    """
    seen = {"hp": F.col("both"), "ap": F.col("both") + F.col("ap_only"), "fke": F.col("both") + F.col("fke_only")}
    rows = cells.select(*by, F.col("n").cast("double").alias("n"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), hits.cast("double").alias("hits")) for m, hits in seen.items()
    ])).alias("_m")).select(*by, "n", "_m.metric", "_m.hits")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in by], "metric")
    uniform = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: hash60(F.concat_ws("|", key, r.cast("string"))) / F.lit(float(2**60))
    ))
    (low, low_next, low_part), (high, high_next, high_part) = interval_places(replicates)
    rows = rows.withColumn("_u", uniform).withColumns({f"_u{i}": F.get("_u", F.lit(i)) for i in {low, low_next, high, high_next}})
    rows = rows.withColumn("p", F.col("hits") / F.col("n")).withColumn("_reach", 12 * F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p"))) + 1)
    first = F.greatest(F.lit(0.0), F.floor(F.col("hits") - F.col("_reach"))).cast("bigint")
    last = F.least(F.col("n"), F.ceil(F.col("hits") + F.col("_reach"))).cast("bigint")
    certain = (F.col("hits") == 0) | (F.col("hits") == F.col("n"))
    places = F.when(certain, F.array(F.col("hits").cast("bigint"))).otherwise(F.sequence(first, last))
    counted = rows.drop("_u").withColumn("k", F.explode(F.transform(places, lambda k: k.cast("double"))))
    chance = F.when(certain, F.lit(1.0)).otherwise(F.expr(binomial_sql("n", "k", "p")))
    upto = W.partitionBy(*by, "metric").orderBy("k")
    summed = counted.withColumn("_cdf", F.sum(chance).over(upto))

    def hits_at(place: int) -> Column:
        return F.coalesce(F.min(F.when(F.col("_cdf") >= F.col(f"_u{place}"), F.col("k"))), F.max("k"))

    def between(a: int, b: int, part: float) -> Column:
        return (hits_at(a) + F.lit(part) * (hits_at(b) - hits_at(a))) * 100 / F.first("n")

    bounds = summed.groupBy(*by, "metric").agg(
        (F.first("hits") * 100 / F.first("n")).alias("observed"),
        between(low, low_next, low_part).alias("lower"),
        between(high, high_next, high_part).alias("upper"),
    )
    return _summary(bounds)


def bootstrap_ci(cells: DataFrame, by: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile bootstrap by resampling the four cell counts.

    Drawing n items with replacement and counting cells is a multinomial draw,
    so a replicate costs four numbers however many items a run has.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                label = "|".join(str(row[c]) for c in by)
                rng = np.random.default_rng([seed, zlib.crc32(label.encode())])
                counts = np.array([row["both"], row["ap_only"], row["fke_only"], row["neither"]], float)
                n = counts.sum()
                draws = rng.multinomial(int(n), counts / n, size=replicates)
                values = {"hp": draws[:, 0], "ap": draws[:, 0] + draws[:, 1], "fke": draws[:, 0] + draws[:, 2]}
                seen = {"hp": counts[0], "ap": counts[0] + counts[1], "fke": counts[0] + counts[2]}
                for metric in METRICS:
                    low, high = np.percentile(values[metric] * 100 / n, [2.5, 97.5])
                    out.append({**{c: row[c] for c in by}, "metric": metric,
                                "observed": seen[metric] * 100 / n, "lower": low, "upper": high})
            yield pd.DataFrame(out, columns=[*by, "metric", "observed", "lower", "upper"])

    schema = f"{fields}, metric string, observed double, lower double, upper double"
    return _summary(cells.mapInPandas(resample, schema))


def listed(column: str, values: Sequence) -> Column:
    """The column, or an error that names the first value a table has no place for, so that none vanishes from it."""
    known = F.col(column).isin(list(values))
    shown = F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
    return F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"no place for {column} "), shown)))


def main_table(cells: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Rows (model, method), columns task_metric; a task that is not listed is an error."""
    long = long_rates(cells, ("task", "model", "method")).withColumn(
        "_column", F.concat_ws("_", listed("task", tasks), F.upper("metric"))
    )
    columns = [f"{t}_{m.upper()}" for t in tasks for m in METRICS]
    return long.groupBy("model", "method").pivot("_column", columns).agg(F.max("rate"))


def scope_table(cells: DataFrame, tasks: Sequence[str], scopes: Sequence[int]) -> DataFrame:
    """HP in percent: rows (model, method), columns task_scope; NULL where a run is missing.

    A task that is not listed is an error; scopes are a choice.
    """
    long = rates(cells).select(
        "model", "method", (F.col("hp") * 100).alias("rate"),
        F.concat_ws("_", listed("task", tasks), F.col("scope").cast("string")).alias("_column"),
    )
    columns = [f"{t}_{s}" for t in tasks for s in scopes]
    return long.groupBy("model", "method").pivot("_column", columns).agg(F.max("rate"))


def best_in_column(long: DataFrame, value: str, column: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Flag the best value of each column; ties within the tolerance are all best."""
    mark = F.coalesce(F.col(value), F.lit(-1.0))
    top = F.max(mark).over(W.partitionBy(*column))
    return long.withColumn("best", (F.abs(mark - top) < tolerance) & F.col(value).isNotNull())


def answer_transition(cells: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """2x2 counts of FKE against the answer, zeros included, for both readings of the answer.

    Kind ap takes the answer pass, kind hp the holistic pass; an item whose
    facts are not all entailed never passes holistically.
    """
    return cells.selectExpr(
        *by,
        "stack(8, 'ap', 'entailed', 'correct', both, 'ap', 'entailed', 'wrong', fke_only,"
        " 'ap', 'failed', 'correct', ap_only, 'ap', 'failed', 'wrong', neither,"
        " 'hp', 'entailed', 'correct', both, 'hp', 'entailed', 'wrong', fke_only,"
        " 'hp', 'failed', 'correct', 0L, 'hp', 'failed', 'wrong', ap_only + neither) as (kind, source, target, value)",
    )


def fact_flows(facts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Per item: counts of known/unknown facts that entail, fail directly or fail by propagation.

    The first failing fact of an item is the direct one and all later ones are
    propagated, so an aggregate is enough: count the failures and keep the
    first. Facts without a class or a known flag are skipped.
    """
    usable = facts.filter(F.col("nli_class").isNotNull() & F.col("knowledgable").isNotNull())
    entailed = F.lower("nli_class") == "entailment"
    first = F.min(F.when(~entailed, F.struct(*order, "knowledgable")))
    per_item = usable.groupBy(key).agg(
        F.count_if(entailed & F.col("knowledgable")).alias("known_entail"),
        F.count_if(entailed & ~F.col("knowledgable")).alias("unknown_entail"),
        F.count_if(~entailed & F.col("knowledgable")).alias("_known_fail"),
        F.count_if(~entailed & ~F.col("knowledgable")).alias("_unknown_fail"),
        first.alias("_first"),
    )
    known_first = F.coalesce(F.col("_first.knowledgable"), F.lit(False)).cast("bigint")
    unknown_first = F.coalesce(~F.col("_first.knowledgable"), F.lit(False)).cast("bigint")
    return per_item.select(
        key, "known_entail", "unknown_entail",
        known_first.alias("known_direct"),
        unknown_first.alias("unknown_direct"),
        (F.col("_known_fail") - known_first).alias("known_propagated"),
        (F.col("_unknown_fail") - unknown_first).alias("unknown_propagated"),
    )


def fact_transition(items: DataFrame, flows: DataFrame, key: str, by: Sequence[str] = ("task",)) -> DataFrame:
    """2x3 counts per task, zeros included."""
    names = [f"{s}_{t}" for s in ("known", "unknown") for t in ("entail", "direct", "propagated")]
    sums = items.select(key, *by).join(flows, key).groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    pairs = ", ".join(f"'{n.split('_')[0]}', '{n.split('_')[1]}', {n}" for n in names)
    return sums.selectExpr(*by, f"stack(6, {pairs}) as (source, target, value)")


def flow_links(matrix: DataFrame, by: Sequence[str] = ("task",), separator: str = "\n") -> DataFrame:
    """Links with row and column shares of all flow in their labels; empty links dropped."""
    total = F.sum("value").over(W.partitionBy(*by))

    def label(side: str) -> Column:
        share = F.sum("value").over(W.partitionBy(*by, side)) * 100 / total
        return F.concat(F.col(side), F.lit(separator), one_decimal(share), F.lit("%"))

    return (
        matrix.withColumn("from", label("source"))
        .withColumn("to", label("target"))
        .filter("value > 0")
        .select(*by, "from", "to", "value")
    )


def dataset_stats(items: DataFrame, facts: DataFrame, key: str, by: Sequence[str] = ("task",)) -> DataFrame:
    """Per task: questions, facts per question, and words of questions, probes and facts."""
    per_item = facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("_facts"),
        F.sum(word_count(F.col("probe_question"))).alias("_probe_words"),
        F.sum(word_count(F.col("knowledge"))).alias("_fact_words"),
    )
    joined = items.select(key, *by, "question").join(per_item, key, "left")
    facts_total = F.sum("_facts")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.coalesce(facts_total, F.lit(0)) / F.count(F.lit(1))).alias("facts_per_item"),
        F.avg(word_count(F.col("question"))).alias("question_words"),
        (F.sum("_probe_words") / facts_total).alias("probe_words"),
        (F.sum("_fact_words") / facts_total).alias("fact_words"),
    )


def exemplars(items: DataFrame, facts: DataFrame, key: str, order: Sequence[str], k: int = 5) -> DataFrame:
    """First k items per task and class, in run order; an item at most once per class.

    Unlike the counts, this pass takes facts whether or not their known flag is set.
    """
    failed = F.lower("nli_class") != "entailment"
    per_item = facts.filter("nli_class is not null").groupBy(key).agg(
        F.count_if(~failed).alias("_entail"), F.count_if(failed).alias("_failed")
    )
    classes = F.filter(
        F.array(
            F.when(F.col("_entail") > 0, "entail"),
            F.when(F.col("_failed") > 0, "direct"),
            F.when(F.col("_failed") > 1, "propagated"),
        ),
        lambda c: c.isNotNull(),
    )
    rank = F.row_number().over(W.partitionBy("task", "class").orderBy(*order))
    return (
        items.join(per_item, key)
        .withColumn("class", F.explode(classes))
        .withColumn("place", rank)
        .filter(F.col("place") <= k)
        .select("task", "class", "place", key)
    )


def compare_runs(cells: DataFrame, baseline: str = "original") -> DataFrame:
    """Metric of each method next to the same task and model without injection."""
    long = long_rates(cells, ("task", "model", "method"))
    base = F.max(F.when(F.col("method") == baseline, F.col("rate"))).over(W.partitionBy("task", "model", "metric"))
    return (
        long.withColumn("base_rate", base)
        .filter(F.col("method") != baseline)
        .withColumn("delta", F.col("rate") - F.col("base_rate"))
    )
