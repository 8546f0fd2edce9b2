"""Nesting, flattening, pairing, scope groups and batching of question items."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.functions import names
from lorescope.functions.hashing import hash60
from lorescope.functions.text import strip
from lorescope.operators.ordering import dense_index, position_in_group
from lorescope.session import cut_lineage


def flatten_probes(items: DataFrame, key: str = "item_id", facts: str = "probe_questions") -> DataFrame:
    """One row per usable fact with a dense global id in (item, position) order.

    A fact without question or answer is dropped; missing knowledge reads 'None'.
    """
    flat = (
        items.select(key, F.posexplode(facts).alias("_pos", "_fact"))
        .filter("_fact.question is not null and _fact.answer is not null")
        .select(
            F.col(key).alias("complex_question_id"), "_pos",
            F.col("_fact.question").alias("question"),
            F.col("_fact.answer").alias("answer"),
            F.coalesce("_fact.knowledge", F.lit("None")).alias("knowledge"),
        )
    )
    kept = ["complex_question_id", "question", "answer", "knowledge"]
    return dense_index(flat, ["complex_question_id", "_pos"], "id", keep=kept)


def nest(items: DataFrame, facts: DataFrame, fields: Sequence[str], name: str, key: str = "item_id") -> DataFrame:
    """Left join of items with their facts as an ordered array; one row per item, empty array if it has none.

    ``facts`` has ``pos`` within the item. A row is as long as its item; where
    items may hold very many facts, stay with the long form (item, pos, ...).
    """
    rows = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_rows"))
    bare = F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return (
        items.join(rows, key, "left")
        .withColumn(name, F.when(F.col("_rows").isNull(), F.array()).otherwise(bare))
        .drop("_rows")
    )


def nest_knowledge(items: DataFrame, probes: DataFrame, key: str = "item_id") -> DataFrame:
    """Reasoning items: those with a question and an answer, and their complete facts in order."""
    fields = ["knowledge", "knowledgable", "knowledge_confidence"]
    usable = probes.dropna("any", subset=fields)
    return nest(items.dropna("any", subset=["question", "answer"]), usable, fields, "required_knowledge", key)


def pair_locality(probes: DataFrame, attempts: int = 3) -> DataFrame:
    """Add efficacy_id (self) and locality_id: another probe of another item with another question.

    Partners are hashed offsets joined by id. A row whose offsets all fail takes
    one of five witnesses, chosen so that one of them fits whenever any partner
    exists; NULL means that none does.
    """
    slim = cut_lineage(probes.select("id", F.col("complex_question_id").alias("p"), F.xxhash64("question").alias("q")))
    row = F.struct("id", "p", "q")

    def smallest(*conditions: Column) -> list:
        """Row with the smallest id under each condition, all in one pass."""
        found = slim.agg(*[F.min(F.when(c, row)).alias(f"w{i}") for i, c in enumerate(conditions)]).first()
        return list(found)

    total = slim.count()
    tries = slim.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    offset = hash60(F.concat_ws("|", F.col("id").cast("string"), F.col("k").cast("string"))) % F.lit(max(total - 1, 1))
    tries = tries.withColumn("other", (F.col("id") + 1 + offset) % F.lit(max(total, 1)))
    others = slim.select(F.col("id").alias("other"), F.col("p").alias("op"), F.col("q").alias("oq"))
    # (attempt, partner) in one number, so that the first that fits is a plain minimum.
    ranked = F.col("k") * F.lit(total) + F.col("other")
    picked = (
        tries.join(others, "other")
        .filter("p <> op and q <> oq")
        .groupBy("id")
        .agg((F.min(ranked) % F.lit(max(total, 1))).alias("_picked"))
    )

    # The first row; the first rows off its item or question; and for each of
    # those a second one that differs from it in the other respect.
    never = F.lit(False)
    (head,) = smallest(F.lit(True))
    off_p = F.col("p") != head["p"] if head else never
    off_q = F.col("q") != head["q"] if head else never
    s1, t1 = smallest(off_p, off_q)
    s2, t2 = smallest(off_p & (F.col("q") != s1["q"]) if s1 else never, off_q & (F.col("p") != t1["p"]) if t1 else never)
    fallback = [
        F.when((F.col("complex_question_id") != w["p"]) & (F.xxhash64("question") != w["q"]), F.lit(w["id"]))
        for w in (head, s1, s2, t1, t2)
        if w is not None
    ]
    return (
        probes.join(picked, "id", "left")
        .withColumn("efficacy_id", F.col("id"))
        .withColumn("locality_id", F.coalesce("_picked", *fallback))
        .drop("_picked")
    )


def lookup_pairs(pairs: DataFrame, probes: DataFrame, fields: Sequence[str] = ("question", "answer")) -> DataFrame:
    """Fetch the efficacy and locality rows of each pair by id."""
    out = pairs.select("id", "efficacy_id", "locality_id")
    for side in ("efficacy", "locality"):
        rows = probes.select(F.col("id").alias(f"{side}_id"), *[F.col(f).alias(f"{side}_{f}") for f in fields])
        out = out.join(rows, f"{side}_id")
    return out


def scope_groups(items: DataFrame, scopes: Sequence[int], index: str = "idx") -> DataFrame:
    """Each item once per scope, in contiguous groups of that many items."""
    return items.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in scopes]))).withColumn(
        "group_id", F.floor(F.col(index) / F.col("scope"))
    )


BLOCK = 10  # groups of the largest scope in a block, at most


def facts_to_inject(
    grouped: DataFrame, facts: DataFrame, only_unknown: bool = True, key: str = "item_id", scopes: Sequence[int] | None = None
) -> DataFrame:
    """Facts of each scope group, each text once, where it is seen first.

    The first occurrence decides: if it has no probe question, later ones do not
    replace it. A missing known flag counts as known. The result stays long, in
    (idx, pos) order, so that no group is collected into one row.

    With ``scopes`` the first argument is the indexed items, not yet grouped. As many items as all scopes divide are a
    block that no group crosses: facts are dealt by block and meet their groups there, so a fact is moved once and not
    once per scope. Scopes without a small common multiple are grouped beforehand.
    """
    usable = facts.filter("knowledge <> ''")
    if only_unknown:
        usable = usable.filter("not coalesce(knowledgable, true)")
    detail = ["knowledgable", "knowledge_confidence", "probe_question", "probe_answer"]
    block, by = math.lcm(*scopes or [1]), []
    if scopes and block <= BLOCK * max(scopes):
        dealt = grouped.select(key, "idx").join(usable, key).withColumn("_block", F.floor(F.col("idx") / block)).repartition("_block")
        seen, by = scope_groups(dealt, scopes), ["_block"]
    else:
        seen = (scope_groups(grouped, scopes) if scopes else grouped).select(key, "idx", "scope", "group_id").join(usable, key)
    return (
        seen.groupBy(*by, "scope", "group_id", "knowledge")
        .agg(F.min(F.struct("idx", "pos", *detail)).alias("_first"))
        .select("scope", "group_id", "knowledge", "_first.*")
        .filter("probe_question is not null")
    )


# The wording models are prompted with, by task.
_USER, _ASSISTANT = "User:\n", "\nAssistant:\n"
_UPDATE = "\nPlease update your knowledge with the following facts:\n"
_CODE_UPDATE = "\nPlease update your knowledge with following facts:\n"


def build_prompt(grouped: DataFrame, injected: DataFrame, code_tasks: Sequence[str] = ("code",)) -> DataFrame:
    """User prompt per item and scope; the facts of its group go in, joined by spaces.

    Texts are distinct within a group, so a prompt is as long as its scope allows.
    """
    texts = injected.groupBy("scope", "group_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "pos", "knowledge"))), lambda r: r["knowledge"]), " "
        ).alias("_facts")
    )
    facts = F.coalesce("_facts", F.lit(""))
    update = F.when(F.col("task").isin(*code_tasks), _CODE_UPDATE).otherwise(_UPDATE)
    with_facts = F.when(facts != "", F.concat(update, facts)).otherwise("")
    prompt = F.concat(F.lit(_USER), F.col("question"), with_facts, F.lit(_ASSISTANT))
    return grouped.join(texts, ["scope", "group_id"], "left").select("item_id", "scope", prompt.alias("prompt"))


def attach_context(results: DataFrame, raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring raw columns to result rows by their recorded position."""
    return results.join(raw, list(keys), "left")


def experiment_grid(runs: DataFrame, dims: Sequence[str], baseline: Mapping[str, object]) -> DataFrame:
    """All combinations of the values each dimension takes, and the baseline combinations.

    The values are gathered into one row of sets and unrolled, so nothing is
    cross joined; the grid is as large as the experiment plan.
    """
    sets = runs.agg(*[F.collect_set(d).alias(d) for d in dims])

    def unroll(frame: DataFrame) -> DataFrame:
        for d in dims:
            frame = frame.withColumn(d, F.explode(d))
        return frame

    types = runs.select(*dims).schema
    fixed = sets.withColumns({d: F.array(F.lit(v).cast(types[d].dataType)) for d, v in baseline.items()})
    return unroll(sets).unionByName(unroll(fixed)).distinct()


def completeness(grid: DataFrame, inputs: DataFrame, outputs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Status of each grid cell from its input and output row counts."""
    n_in = inputs.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_in"))
    n_out = outputs.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_out"))
    counted = grid.join(n_in, list(dims), "left").join(n_out, list(dims), "left").fillna(0, ["n_in", "n_out"])
    status = F.when(F.col("n_in") == 0, "No Input").when(F.col("n_out") >= F.col("n_in"), "Complete").otherwise("Pending")
    return counted.withColumn("status", status)


def model_dim(
    models: DataFrame, aliases: DataFrame, overrides: Mapping[str, float], default: float, name: str = "model"
) -> DataFrame:
    """Full name (or itself), size in billions from the name, and memory in GB."""
    size = F.regexp_extract(F.lower(name), r"(\d+(\.\d+)?)b", 1)
    known = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    parsed = F.when(size != "", F.try_to_number(size, F.lit("999999.999999")).cast("double"))
    memory = F.coalesce(*([known[F.concat(size, F.lit("b"))]] if overrides else []), parsed * 4.0, F.lit(default))
    full = aliases.select(F.col("alias").alias(name), "full_name")
    return models.join(full, name, "left").select(
        *models.columns,
        F.coalesce("full_name", name).alias("full_name"),
        parsed.alias("size_b"),
        memory.cast("double").alias("memory_gb"),
    )


def display_names(runs: DataFrame) -> DataFrame:
    """Add the names reports use for task, model and method; unknown ones keep their own."""

    def named(column: str, table: Mapping[str, str], otherwise: Column) -> Column:
        return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in table.items()], otherwise)

    method = F.when((F.col("model") == names.THINKING_ONLY) & (F.col("method") == "base"), names.METHODS["append_t"]).otherwise(
        named("method", names.METHODS, F.col("method"))
    )
    return runs.withColumns({
        "task_name": named("task", names.TASKS, F.upper("task")),
        "model_name": named("model", names.MODELS, F.col("model")),
        "method_name": method,
    })


def usage_totals(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """Token sums by each prefix of ``by``, down to the grand total."""
    return usage.rollup(*by).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def length_batches(rows: DataFrame, length: str, budget: int, order: Sequence[str]) -> DataFrame:
    """Batches of rows by falling length, none wider than ``budget`` after padding.

    Rows of equal length are interchangeable up to ``order``, so the batch
    boundaries follow from the counts per length alone: that small table (one
    row per distinct length) is walked once, and every row then finds its batch
    from its rank among equals. A row longer than the budget is a batch by
    itself; rows of length 0 are left out.
    """
    rows = rows.filter(F.col(length) > 0)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = pd.concat(list(batches), ignore_index=True)
        current, room, out = -1, 0, []
        for width, n in counts.sort_values(length, ascending=False).itertuples(index=False):
            capacity = max(1, int(budget // width))
            joined = min(int(n), room)
            rest = int(n) - joined
            opened = -(-rest // capacity)
            out.append((width, current, joined, capacity))
            current += opened
            room = opened * capacity - rest if rest else room - joined
        yield pd.DataFrame(out, columns=[length, "_open", "_joined", "_capacity"])

    kind = rows.schema[length].dataType.simpleString()
    lengths = rows.groupBy(length).agg(F.count(F.lit(1)).alias("_rows"))
    plan = lengths.repartition(1).mapInPandas(walk, f"{length} {kind}, _open bigint, _joined bigint, _capacity bigint")
    ranked = position_in_group(rows, [length], order, "_rank")
    beyond = F.col("_rank") - F.col("_joined")
    batch = F.when(beyond < 0, F.col("_open")).otherwise(F.col("_open") + 1 + F.floor(beyond / F.col("_capacity")))
    return ranked.join(plan, length).withColumn("batch", batch).drop("_rank", "_open", "_joined", "_capacity")


def pad_to_width(values: Column, width: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, (width - F.size(values)).cast("int")))


def attention_mask(size: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), size.cast("int")), F.array_repeat(F.lit(0), (width - size).cast("int")))


def flatten_masked(batch: DataFrame, values: str, mask: str, keep: Sequence[str]) -> DataFrame:
    """One row per attended position of padded arrays."""
    return batch.select(*keep, F.posexplode(F.arrays_zip(F.col(values).alias("value"), F.col(mask).alias("attended"))).alias("pos", "_c")).filter(
        "_c.attended = 1"
    ).select(*keep, "pos", F.col("_c.value").alias("value"))


def subset(rows: DataFrame, key: str, n: int, pseudorandom: bool = True, where: Column | None = None) -> DataFrame:
    """n rows: the first by key, or a fixed pseudorandom choice; all when there are fewer."""
    if where is not None:
        rows = rows.filter(where)
    order = [hash60(F.col(key).cast("string")), F.col(key)] if pseudorandom else [F.col(key)]
    return rows.orderBy(*order).limit(n)


def qa_history(steps: DataFrame, key: str, order: str, max_steps: int) -> DataFrame:
    """Running transcript of the first ``max_steps`` question-answer steps of each conversation."""
    by_turn = W.partitionBy(key).orderBy(order)
    line = F.concat(F.lit("Subquestion: "), "question", F.lit("\nGenerated Answer: "), "answer", F.lit("\n"))
    first = steps.withColumn("step_no", F.row_number().over(by_turn)).filter(F.col("step_no") <= max_steps)
    so_far = F.collect_list(line).over(by_turn.rowsBetween(W.unboundedPreceding, 0))
    return first.select(key, "step_no", strip(F.array_join(so_far, "")).alias("history"))
