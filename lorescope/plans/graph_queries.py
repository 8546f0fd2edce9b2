"""Chains over a knowledge graph of orders, customers, nations, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorescope.operators import graph as B
from lorescope.plans.registry import Inputs, query
from lorescope.plans.text_queries import checksum, sql_checksum

WALKED = ("placed_by", "contains", "lives_in", "first_order", "top_customer", "part_of", "has_brand")
_WALKED_SQL = ", ".join(f"'{p}'" for p in WALKED)
SUBJECT_RULES = {"placed_by": "order", "lives_in": "party", "top_customer": "place"}
OBJECT_RULES = {"placed_by": "agent", "lives_in": "place", "based_in": "agent"}
DAY = "2026-01-05"
DEPTHS = (2, 3, 4, 5, 6)
TEMPLATES = {
    "placed_by": ("Who placed [S]?", "[S] was placed by ___.", "the buyer of [S]"),
    "contains": ("What does [S] contain?", "[S] contains ___.", "the part in [S]"),
    "lives_in": ("Where does [S] live?", "[S] lives in ___.", "the nation of [S]"),
    "first_order": ("What was the first order of [S]?", "The first order of [S] is ___.", "the first order of [S]"),
    "top_customer": ("Who is the top customer in [S]?", "The top customer in [S] is ___.", "the top customer in [S]"),
    "part_of": ("What is [S] part of?", "[S] is part of ___.", "the region of [S]"),
    "based_in": ("Where is [S] based?", "[S] is based in ___.", "the seat of [S]"),
    "has_brand": ("Which brand does [S] have?", "The brand of [S] is ___.", "the brand of [S]"),
}
PROP_NAMES = {
    "placed_by": "buyer", "contains": "part", "lives_in": "nation", "first_order": "first order",
    "top_customer": "top customer", "part_of": "region", "based_in": "seat", "has_brand": "brand",
}


def bad_triples(t: Inputs) -> DataFrame:
    """Claims found to be wrong earlier: the contents of taxed-most lines."""
    return t.lineitem.filter("l_tax >= 0.08").select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("subj"),
        F.lit("contains").alias("prop"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("obj"),
    )


def edges(t: Inputs) -> DataFrame:
    allowed = B.allowed_props(t.triples, WALKED)
    return B.walkable(allowed, bad_triples(t), t.entity_labels, t.prop_labels, typed(t), SUBJECT_RULES, OBJECT_RULES)


def starts(t: Inputs) -> DataFrame:
    return t.orders.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"))


@query("b1_single_valued", """
    SELECT subj, prop, min(obj) AS obj, min(prop_rank) AS prop_rank FROM {triples} GROUP BY subj, prop HAVING count(*) = 1""")
def b1(t):
    return B.single_valued(t.triples)


@query("b2_allowed_props", f"""
    SELECT prop, count(*) AS n, count(DISTINCT subj) AS subjects FROM {{triples}} WHERE prop IN ({_WALKED_SQL}) GROUP BY prop""")
def b2(t):
    return B.allowed_props(t.triples, WALKED).groupBy("prop").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subj").alias("subjects")
    )


_LABELLED = """labelled AS (SELECT t.subj, t.prop, t.obj, coalesce(s.label, '') AS subj_label, coalesce(prop_label, '') AS prop_label, coalesce(o.label, '') AS obj_label
      FROM {triples} t LEFT JOIN {prop_labels} p ON t.prop = p.prop LEFT JOIN {entity_labels} s ON t.subj = s.id LEFT JOIN {entity_labels} o ON t.obj = o.id)"""


def labelled(t: Inputs) -> DataFrame:
    return B.with_labels(t.triples, t.entity_labels, t.prop_labels)


@query("b3_labels", "WITH " + _LABELLED + f"""
    SELECT prop, prop_label, count(*) AS n, count(*) FILTER (WHERE obj_label = '') AS unlabelled, {sql_checksum('subj_label')} AS subjects,
      {sql_checksum('obj_label')} AS objects FROM labelled GROUP BY prop, prop_label""")
def b3(t):
    return labelled(t).groupBy("prop", "prop_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("obj_label") == "").alias("unlabelled"),
        checksum(F.col("subj_label")).alias("subjects"), checksum(F.col("obj_label")).alias("objects"),
    )


_OK = "{c} <> '' AND len(regexp_extract_all({c}, '\\S+')) <= 5 AND length({c}) <= 50"


@query("b4_label_filter", "WITH " + _LABELLED + f"""
    SELECT prop, count(*) AS n, {sql_checksum("concat(subj, obj)")} AS digest FROM labelled
    WHERE prop_label <> '' AND {_OK.format(c='subj_label')} AND {_OK.format(c='obj_label')} GROUP BY prop""")
def b4(t):
    return B.usable_labels(labelled(t)).groupBy("prop").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.concat("subj", "obj")).alias("digest")
    )


TARGETS = ("agent", "place", "party", "order", "thing")
_CLOSURE = """closure AS (SELECT unnest(['agent', 'place', 'party', 'order', 'thing']) AS target, target AS class
      UNION SELECT target, sub FROM closure JOIN {subclass_of} ON sup = class),
    typed AS (SELECT DISTINCT subj, target FROM {instance_of} i JOIN closure c ON i.class = c.class)"""


def typed(t: Inputs) -> DataFrame:
    return B.instances(t.instance_of, B.descendants(t.subclass_of, TARGETS))


@query("b5_type_closure", "WITH RECURSIVE " + _CLOSURE + f"""
    SELECT target, substr(subj, 1, 1) AS kind, count(*) AS n, {sql_checksum('subj')} AS digest FROM typed GROUP BY ALL""")
def b5(t):
    return typed(t).groupBy("target", F.substring("subj", 1, 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), checksum(F.col("subj")).alias("digest")
    )


@query("b6_domain_range", "WITH RECURSIVE " + _CLOSURE + f"""
    SELECT prop, count(*) AS n, {sql_checksum("concat(subj, obj)")} AS digest FROM {{triples}} t
    WHERE (prop NOT IN ('placed_by', 'lives_in', 'top_customer') OR (subj, CASE prop WHEN 'placed_by' THEN 'order' WHEN 'lives_in' THEN 'party' ELSE 'place' END)
        IN (SELECT (subj, target) FROM typed))
      AND (prop NOT IN ('placed_by', 'lives_in', 'based_in') OR (obj, CASE prop WHEN 'lives_in' THEN 'place' ELSE 'agent' END) IN (SELECT (subj, target) FROM typed))
    GROUP BY prop""")
def b6(t):
    kept = B.domain_range_ok(t.triples, typed(t), SUBJECT_RULES, OBJECT_RULES)
    return kept.groupBy("prop").agg(F.count(F.lit(1)).alias("n"), checksum(F.concat("subj", "obj")).alias("digest"))


@query("b7_popular", "SELECT obj AS id, count(*) AS links FROM {triples} GROUP BY obj HAVING count(*) >= 5")
def b7(t):
    return B.popular(t.triples)


@query("b8_sample", """
    SELECT id, links FROM (SELECT obj AS id, count(*) AS links FROM {triples} GROUP BY obj HAVING count(*) >= 5) p
    ORDER BY ('0x' || substr(md5(id), 1, 15))::BIGINT, id LIMIT 500""")
def b8(t):
    return B.sample_starts(B.popular(t.triples), 500)


_BAD = "bad AS (SELECT concat('O', l_orderkey) AS subj, 'contains' AS prop, concat('P', l_partkey) AS obj FROM {lineitem} WHERE l_tax >= 0.08)"


@query("b9_exclude", "WITH " + _BAD + f"""
    SELECT prop, count(*) AS n, {sql_checksum("concat(subj, obj)")} AS digest FROM {{triples}} t
    WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.subj = t.subj AND b.prop = t.prop AND b.obj = t.obj) GROUP BY prop""")
def b9(t):
    return B.exclude_known_bad(t.triples, bad_triples(t)).groupBy("prop").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.concat("subj", "obj")).alias("digest")
    )


# The walk as the rule says it: of all claims of the subject, a property counts when it has one claim; that claim must
# not be known to be bad, have usable labels and the classes asked for, and lead somewhere new by a new property.
_WALK = "WITH RECURSIVE " + _CLOSURE + ", " + _LABELLED + ", " + _BAD + f""",
    counted AS (SELECT *, count(*) OVER (PARTITION BY subj, prop) AS claims FROM labelled),
    ranks AS (SELECT DISTINCT prop, prop_rank FROM {{triples}}),
    edges AS (SELECT c.subj, c.prop, c.obj, prop_rank FROM counted c JOIN ranks r ON c.prop = r.prop
      WHERE c.prop IN ({_WALKED_SQL}) AND claims = 1
        AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.subj = c.subj AND b.prop = c.prop AND b.obj = c.obj)
        AND prop_label <> '' AND {_OK.format(c='subj_label')} AND {_OK.format(c='obj_label')}
        AND (c.prop <> 'placed_by' OR EXISTS (SELECT 1 FROM typed t WHERE t.subj = c.subj AND target = 'order'))
        AND (c.prop <> 'lives_in' OR EXISTS (SELECT 1 FROM typed t WHERE t.subj = c.subj AND target = 'party'))
        AND (c.prop <> 'top_customer' OR EXISTS (SELECT 1 FROM typed t WHERE t.subj = c.subj AND target = 'place'))
        AND (c.prop <> 'lives_in' OR EXISTS (SELECT 1 FROM typed t WHERE t.subj = c.obj AND target = 'place'))
        AND (c.prop NOT IN ('placed_by', 'based_in') OR EXISTS (SELECT 1 FROM typed t WHERE t.subj = c.obj AND target = 'agent'))),
    walk AS (SELECT concat('O', o_orderkey) AS start, [concat('O', o_orderkey)] AS path, []::VARCHAR[] AS props, 0 AS hops FROM {{orders}}
      UNION ALL SELECT start, list_append(path, obj), list_append(props, prop), hops + 1 FROM (
        SELECT w.*, prop, obj, row_number() OVER (PARTITION BY start ORDER BY prop_rank, prop, obj) AS rn FROM walk w JOIN edges ON subj = path[-1]
        WHERE hops < 6 AND NOT list_contains(path, obj) AND NOT list_contains(props, prop)) x WHERE rn = 1),
    chains AS (SELECT start, arg_max(path, hops) AS path, arg_max(props, hops) AS props FROM walk GROUP BY start)"""


@query("b10_walk", _WALK + """
    SELECT start, len(props)::INT AS hops, array_to_string(path, '>') AS path, array_to_string(props, '>') AS props FROM chains""")
def b10(t):
    chains = B.walk_chains(starts(t), edges(t), max(DEPTHS))
    return chains.select("start", F.size("props").alias("hops"), F.array_join("path", ">").alias("path"), F.array_join("props", ">").alias("props"))


@query("b11_exact_depth", _WALK + """
    SELECT start, hops::INT AS depth, array_to_string(path, '>') AS path FROM walk WHERE hops BETWEEN 2 AND 6""")
def b11(t):
    chains = B.at_depths(B.walk_chains(starts(t), edges(t), max(DEPTHS)), DEPTHS)
    return chains.select("start", "depth", F.array_join("path", ">").alias("path"))


@query("b12_depth_strata", """
    SELECT id, ([2, 3, 4, 5, 6])[((row_number() OVER (ORDER BY id) - 1) * 5 // (count(*) OVER ()) + 1)::INT]::INT AS depth
    FROM (SELECT concat('O', o_orderkey) AS id FROM {orders}) x""")
def b12(t):
    return B.stratify_depth(starts(t), DEPTHS)


def _case(column: str, part: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{p}' THEN '{w[part]}'" for p, w in TEMPLATES.items()) + " END"


@query("b13_probe_text", "WITH " + _LABELLED + f""",
    raw AS (SELECT prop, obj_label, replace({_case('prop', 0)}, '[S]', subj_label) AS q,
      replace(replace({_case('prop', 1)}, '[S]', subj_label), '___', obj_label) AS k FROM labelled)
    SELECT prop, count(*) AS n, {sql_checksum("concat('By ', strftime(DATE '" + DAY + "', '%b. %d, %Y'), ', ', lower(q[1]), q[2:])")} AS questions,
      {sql_checksum('obj_label')} AS answers, {sql_checksum('k')} AS knowledge FROM raw GROUP BY prop""")
def b13(t):
    probes = B.render_probe(labelled(t), TEMPLATES, F.lit(DAY).cast("date"))
    return probes.groupBy("prop").agg(
        F.count(F.lit(1)).alias("n"), checksum(F.col("question")).alias("questions"),
        checksum(F.col("answer")).alias("answers"), checksum(F.col("knowledge")).alias("knowledge"),
    )


def asked_chains(t: Inputs) -> DataFrame:
    """Chains of at least one hop with the label of their head."""
    heads = t.entity_labels.select(F.col("id").alias("start"), F.col("label").alias("head"))
    return B.walk_chains(starts(t), edges(t), max(DEPTHS)).filter(F.size("props") > 0).join(heads, "start")


_COMPOSED = """heads AS (SELECT c.*, label AS head FROM chains c JOIN {entity_labels} ON start = id WHERE len(props) > 0)"""


@query("b14_compose", _WALK + ", " + _COMPOSED + f""",
    fold AS (SELECT start, props, head AS built, 1 AS i FROM heads
      UNION ALL SELECT start, props, replace({_case('props[i]', 2)}, '[S]', built), i + 1 FROM fold WHERE i < len(props)),
    asked AS (SELECT start, replace({_case('props[i]', 0)}, '[S]', built) AS q FROM fold WHERE i = len(props))
    SELECT start, concat('By Jan. 05, 2026, ', lower(q[1]), q[2:]) AS question FROM asked""")
def b14(t):
    question = B.compose_question(F.col("props"), F.col("head"), TEMPLATES, F.lit(DAY).cast("date"))
    return asked_chains(t).select("start", question.alias("question"))


_NAMES_SQL = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROP_NAMES.items()) + " END"


@query("b15_possessive", _WALK + ", " + _COMPOSED + f"""
    SELECT start, concat('What is ', head, '''s ', array_to_string(list_transform(props, lambda p: {_NAMES_SQL}), '''s '), '?') AS question FROM heads""")
def b15(t):
    return asked_chains(t).select("start", B.possessive_question(F.col("props"), F.col("head"), PROP_NAMES).alias("question"))


@query("b16_similar", """
    WITH classes AS (SELECT * FROM {instance_of} UNION ALL SELECT id, 'popular' FROM (SELECT obj AS id FROM {triples} GROUP BY obj HAVING count(*) >= 5) p),
    firsts AS (SELECT subj, min(class) AS class FROM classes GROUP BY subj)
    SELECT subj, class, coalesce(lead(subj) OVER w, first_value(subj) OVER w) AS similar FROM firsts
    WHERE class IN (SELECT class FROM firsts GROUP BY class HAVING count(*) > 1) WINDOW w AS (PARTITION BY class ORDER BY md5(subj), subj)""")
def b16(t):
    # Popular entities have a second class, which comes first only where its name does.
    more = B.popular(t.triples).select(F.col("id").alias("subj"), F.lit("popular").alias("class"))
    return B.similar_entity(B.first_class(t.instance_of.unionByName(more), "class"))
