"""Walking a triples table into multi-hop question chains."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.functions.hashing import hash60
from lorescope.functions.text import word_count
from lorescope.operators.ordering import dense_index, position_in_group
from lorescope.session import cut_lineage


def single_valued(triples: DataFrame) -> DataFrame:
    """Claims whose subject and property have exactly one value."""
    return (
        triples.repartition("subj", "prop")  # claims of a subject lie apart, so only their sorted union is grouped
        .groupBy("subj", "prop")
        .agg(F.min("obj").alias("obj"), F.min("prop_rank").alias("prop_rank"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )


def allowed_props(triples: DataFrame, props: Sequence[str]) -> DataFrame:
    """Claims with a listed property; the list is short, so it becomes a pushed-down filter."""
    return triples.filter(F.col("prop").isin(list(props)))


def with_labels(triples: DataFrame, labels: DataFrame, prop_labels: DataFrame) -> DataFrame:
    """Attach subject, property and object labels; '' where there is none.

    Labels are as many as entities and shrink well in a shuffle: by that size they would be sent whole to every task,
    where they take many times as much, so they are merged.
    """
    subj = labels.select(F.col("id").alias("subj"), F.col("label").alias("subj_label"))
    obj = labels.select(F.col("id").alias("obj"), F.col("label").alias("obj_label"))
    names = ("subj_label", "prop_label", "obj_label")
    joined = triples.join(prop_labels, "prop", "left").join(subj.hint("merge"), "subj", "left").join(obj.hint("merge"), "obj", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit("")) for n in names})


def label_ok(label: Column) -> Column:
    """A usable entity label: not empty, at most 5 words and 50 characters."""
    return (label != "") & (word_count(label) <= 5) & (F.length(label) <= 50)


def usable_labels(labelled: DataFrame) -> DataFrame:
    return labelled.filter(label_ok(F.col("subj_label")) & label_ok(F.col("obj_label")) & (F.col("prop_label") != ""))


def descendants(subclass_of: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(class, target) for every class at or below a target class.

    Grows from the few targets downwards, one level per round, so the whole
    closure of a large hierarchy is never built. Cycles end it as well.
    """
    spark = subclass_of.sparkSession
    # Written like every level, so that the size of the closure is known to the joins that use it.
    reached = cut_lineage(spark.createDataFrame([(t, t) for t in targets], "class string, target string").coalesce(1))
    frontier = reached
    links = subclass_of.select(F.col("sup").alias("class"), F.col("sub"))
    while True:
        below = frontier.join(links, "class").select(F.col("sub").alias("class"), "target").distinct()
        frontier = cut_lineage(below.join(reached, ["class", "target"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)  # each level is a written table


def instances(instance_of: DataFrame, classes: DataFrame) -> DataFrame:
    """(subj, target) for entities that are instances of a target class or of one below it.

    Most classes hold few entities and one may hold most, so rows are dealt by entity before they are made distinct.
    """
    return instance_of.join(classes, "class").select("subj", "target").repartition("subj", "target").distinct()


def domain_range_ok(
    triples: DataFrame, typed: DataFrame, subject_rules: Mapping[str, str], object_rules: Mapping[str, str]
) -> DataFrame:
    """Keep claims whose subject and object have the class their property asks for."""

    def checked(frame: DataFrame, column: str, rules: Mapping[str, str]) -> DataFrame:
        wanted = F.coalesce(*[F.when(F.col("prop") == p, F.lit(c)) for p, c in rules.items()])
        has = typed.select(F.col("subj").alias(column), F.col("target").alias("_wanted"), F.lit(True).alias("_has"))
        # A claim without a rule wants nothing, and a NULL key meets no one.
        joined = frame.withColumn("_wanted", wanted).join(has, [column, "_wanted"], "left")
        return joined.filter("_wanted is null or _has").select(*frame.columns)

    for column, rules in (("subj", subject_rules), ("obj", object_rules)):
        if rules:
            triples = checked(triples, column, rules)
    return triples


def popular(triples: DataFrame, minimum: int = 5) -> DataFrame:
    """Entities linked to at least ``minimum`` times."""
    return triples.groupBy(F.col("obj").alias("id")).agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") >= minimum)


def sample_starts(entities: DataFrame, n: int, key: str = "id") -> DataFrame:
    """n entities in a fixed pseudorandom order."""
    return entities.orderBy(hash60(F.col(key)), key).limit(n)


def exclude_known_bad(rows: DataFrame, bad: DataFrame, keys: Sequence[str] = ("subj", "prop", "obj")) -> DataFrame:
    """Drop rows on an exclusion list: claims found wrong, or items by their id."""
    return rows.join(bad, list(keys), "left_anti")


def walkable(triples: DataFrame, bad: DataFrame, labels: DataFrame, prop_labels: DataFrame, typed: DataFrame,
             subject_rules: Mapping[str, str], object_rules: Mapping[str, str]) -> DataFrame:
    """Claims a walk may follow, as (subj, prop, obj, prop_rank).

    Whether a claim is the only one of its subject and property is asked over
    all its claims, before claims known to be bad are dropped; then labels and
    the classes the property asks for are checked.
    """
    sound = exclude_known_bad(single_valued(triples), bad)
    named = usable_labels(with_labels(sound, labels, prop_labels)).select("subj", "prop", "obj", "prop_rank")
    return domain_range_ok(named, typed, subject_rules, object_rules)


HOT = 200  # nodes whose edges travel to the chains
HOT_SHARE = 1000  # a node is hot from one chain in so many on


def hot_nodes(rows: DataFrame, node: str) -> DataFrame:
    """At most HOT nodes that hold a thousandth or more of the rows each, by a sketch of fixed size; a table of one column.

    A node the sketch misses is looked up by key like any other.
    """
    counted = rows.agg(F.call_function("approx_top_k", F.col(node), F.lit(HOT), F.lit(10 * HOT)).alias("top"), F.count(F.lit(1)).alias("n"))
    top = counted.select("n", F.inline("top"))
    return top.filter((F.col("count") * HOT_SHARE >= F.col("n")) & F.col("item").isNotNull()).select(F.col("item").alias(node))


def walk_chains(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Walk from every start along the first usable edge per hop, up to ``depth`` hops.

    ``edges`` are single-valued, so a subject has at most one edge per property
    and its edges fit one short array. A hop is then a lookup of the current
    node, and the choice (lowest property rank, object not visited, property not
    used) happens inside the row. Which edge is first depends on the path, so
    edges are not ranked beforehand. A chain that cannot go on leaves the loop,
    so no later hop moves it. Chains at popular nodes do not move either: a
    sketch finds the HOT nodes most chains stand at, and their edges, one short
    array each, travel to the chains; the rest meets its edges by key.
    """
    out = edges.groupBy(F.col("subj").alias("_at")).agg(
        F.array_sort(F.collect_list(F.struct("prop_rank", "prop", "obj"))).alias("_out")
    )
    out = cut_lineage(out)
    chains = starts.select(
        F.col("id").alias("start"), F.array("id").alias("path"), F.array().cast("array<string>").alias("props"),
        F.col("id").alias("_at"),
    )
    ended: list[DataFrame] = []
    for _ in range(depth):
        usable = F.filter(
            "_out", lambda e: ~F.array_contains(F.col("path"), e["obj"]) & ~F.array_contains(F.col("props"), e["prop"])
        )
        step = F.get(usable, F.lit(0))
        hot = [r["_at"] for r in hot_nodes(chains, "_at").collect()]  # HOT at most
        others = chains.filter(~F.col("_at").isin(hot)).join(out, "_at", "left")
        if hot:
            crowded = chains.filter(F.col("_at").isin(hot)).join(F.broadcast(out.filter(F.col("_at").isin(hot))), "_at", "left")
            others = others.unionByName(crowded)
        moved = others.withColumn("_step", step).drop("_out", "_at")
        moved = cut_lineage(moved.select(
            "start",
            F.when(F.col("_step").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_step.obj"))).alias("path"),
            F.when(F.col("_step").isNull(), F.col("props")).otherwise(F.concat("props", F.array("_step.prop"))).alias("props"),
            F.col("_step.obj").alias("_at"),
        ))
        ended.append(moved.filter("_at is null"))
        chains = moved.filter("_at is not null")
    return functools.reduce(DataFrame.unionByName, ended, chains).drop("_at")


def exact_depth(chains: DataFrame, depth: int) -> DataFrame:
    return chains.filter(F.size("path") == depth + 1)


def at_depths(chains: DataFrame, depths: Sequence[int]) -> DataFrame:
    """The chain of exactly each asked depth from every start that gets so far.

    A step depends only on the path before it, so the walk to a smaller depth
    is the beginning of the walk to a larger one.
    """
    asked = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size("props"))
    each = chains.withColumn("depth", F.explode(asked))
    return each.withColumns({"path": F.slice("path", F.lit(1), F.col("depth") + 1), "props": F.slice("props", F.lit(1), F.col("depth"))})


def stratify_depth(starts: DataFrame, depths: Sequence[int], order: Sequence[str] = ("id",)) -> DataFrame:
    """Assign depths in equal contiguous shares of the starts, in whole numbers."""
    numbered = dense_index(starts, list(order), "_i")
    total = starts.count()
    share = F.floor(F.col("_i") * len(depths) / F.lit(max(total, 1)))
    return numbered.withColumn("depth", F.get(F.array(*[F.lit(d) for d in depths]), share.cast("int"))).drop("_i")


def _wording(templates: Mapping[str, tuple[str, str, str]], part: int) -> Column:
    return F.create_map(*[F.lit(x) for prop, t in templates.items() for x in (prop, t[part])])


def dated(question: Column, day: Column) -> Column:
    """``By Jan. 05, 2026, who ...?`` with the first letter of the question lowered."""
    lowered = F.concat(F.lower(F.substring(question, 1, 1)), F.substr(question, F.lit(2)))
    return F.concat(F.lit("By "), F.date_format(day, "MMM. dd, yyyy"), F.lit(", "), lowered)


def render_probe(labelled: DataFrame, templates: Mapping[str, tuple[str, str, str]], day: Column) -> DataFrame:
    """Probe question, answer and knowledge sentence of each labelled claim with a template."""
    subj, obj = F.col("subj_label"), F.col("obj_label")
    question = F.replace(_wording(templates, 0)[F.col("prop")], F.lit("[S]"), subj)
    cloze = F.replace(F.replace(_wording(templates, 1)[F.col("prop")], F.lit("[S]"), subj), F.lit("___"), obj)
    return labelled.filter(F.col("prop").isin(list(templates))).select(
        "subj", "prop", "obj", dated(question, day).alias("question"), obj.alias("answer"), cloze.alias("knowledge")
    )


def compose_question(props: Column, head: Column, templates: Mapping[str, tuple[str, str, str]], day: Column) -> Column:
    """Nest attributive phrases from the head on, and ask with the last property's question."""
    attributive, asking = _wording(templates, 2), _wording(templates, 0)
    subject = F.aggregate(
        F.slice(props, F.lit(1), F.greatest(F.size(props) - 1, F.lit(0))), head, lambda acc, p: F.replace(attributive[p], F.lit("[S]"), acc)
    )
    return dated(F.replace(asking[F.get(props, F.size(props) - 1)], F.lit("[S]"), subject), day)


def possessive_question(props: Column, head: Column, prop_names: Mapping[str, str]) -> Column:
    """``What is H's p1's p2?``"""
    names = F.create_map(*[F.lit(x) for pair in prop_names.items() for x in pair])
    return F.concat(F.lit("What is "), head, F.lit("'s "), F.array_join(F.transform(props, lambda p: names[p]), "'s "), F.lit("?"))


def first_class(instance_of: DataFrame, order: str) -> DataFrame:
    """The class that comes first among the classes of each entity."""
    first = instance_of.groupBy("subj").agg(F.min(F.struct(F.col(order).alias("_order"), "class")).alias("_c"))
    return first.select("subj", F.col("_c.class").alias("class"))


def similar_entity(instance_of: DataFrame) -> DataFrame:
    """For each entity another one of the same class, its successor in a fixed shuffled order.

    ``instance_of`` has one class per entity; see ``first_class``.

    The order is cyclic, so everyone gets a partner unless the class has one
    member, without pairing all members of a class.
    """
    shuffled = instance_of.withColumn("_draw", F.md5("subj"))
    placed = position_in_group(shuffled, ["class"], ["_draw", "subj"], "_pos").drop("_draw")
    sizes = placed.groupBy("class").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    following = placed.join(sizes, "class").withColumn("_next", (F.col("_pos") + 1) % F.col("_n"))
    others = placed.select("class", F.col("_pos").alias("_next"), F.col("subj").alias("similar"))
    return following.join(others, ["class", "_next"]).select("subj", "class", "similar")
