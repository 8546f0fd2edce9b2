"""Secret scans by a trigram index over the texts, in SQL functions only.

Every rule is a regular expression. From its syntax tree follows which trigrams a matching text must have, as
alternatives of sets (``trigram_query``). The index has, per trigram and block of rows, the bitmap of the rows whose
lower-case text holds the trigram. A rule's candidates are the union, over its alternatives, of the intersected
bitmaps; only these rows are searched with the expression. A rule without mandatory trigrams is searched for in all
rows. Matches of a rule are leftmost and do not overlap; those with too short a value are dropped after matching, so
they still hide what begins inside them. Positions count code points, the end is exclusive.

Cases: a NULL text counts as empty and has no spans; NULL keys and repeated rows are searched each; equal spans of
several rules are all kept; an empty table gives an empty result; extra columns are ignored, whatever their names.
The index reads a text once per trigram and a search twice, so very long texts cost in proportion to their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.llm.common import let
from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage

_syntax = re._parser  # the standard library's own reading of an expression

BLOCK_BITS = 15  # rows of a block, as many as a bitmap of Spark's bitmap functions has bits
MOST_STRINGS = 64  # strings or alternatives kept while deriving a query; beyond it the query asks for less
MOST_SENT = 64 << 20  # bytes of candidate bitmaps that travel to the rows; with more, both sides are shuffled by block


class Rule(NamedTuple):
    kind: str
    pattern: str  # read alike by Java, Python and RE2
    value: int = 0  # the group whose length counts
    least: int = 1  # code points the value must have
    any_case: bool = False


#: The first three are given; the others are the published shapes of keys.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@"),
)
BASE = ("assign", "access", "hex")

Strings = frozenset[str]
Query = frozenset[Strings]  # alternatives of trigrams that must all occur
ANY: Query = frozenset({frozenset()})
_NOTHING: Strings = frozenset({""})


class _Known(NamedTuple):
    """What is known of the strings a part of an expression matches."""

    exact: Strings | None  # all of them
    starts: Strings  # what they start with, two characters at most
    ends: Strings
    needs: Query


_UNKNOWN = _Known(None, _NOTHING, _NOTHING, ANY)


def _least(alternatives: Iterable[Strings]) -> Query:
    """Without alternatives that ask for more than another does."""
    found: list[Strings] = []
    for a in sorted(set(alternatives), key=len):
        if not any(b <= a for b in found):
            found.append(a)
    return frozenset(found) if len(found) <= MOST_STRINGS else ANY


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS**2:
        return a if len(a) <= len(b) else b
    joined = _least(x | y for x, y in product(a, b))
    return joined if joined != ANY else (a if a != ANY else b)


def _trigrams(strings: Strings) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _crossed(a: Strings, b: Strings) -> Strings | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= MOST_STRINGS else None


def _open(part: _Known) -> _Known:
    """The same with the exact strings given up for their trigrams and edges."""
    if part.exact is None:
        return part
    edges = frozenset(s[:2] for s in part.exact), frozenset(s[-2:] for s in part.exact)
    return _Known(None, *edges, _both(part.needs, _trigrams(part.exact)))


def _then(a: _Known, b: _Known) -> _Known:
    whole = _crossed(a.exact, b.exact) if a.exact is not None and b.exact is not None else None
    if whole is not None:
        return _Known(whole, whole, whole, _both(a.needs, b.needs))
    left, right = _open(a), _open(b)
    seam = _crossed(left.ends, right.starts)
    needs = _both(left.needs, right.needs)
    if seam is not None:
        needs = _both(needs, _trigrams(seam))
    starts = _crossed(a.exact, right.starts) if a.exact is not None else None
    ends = _crossed(left.ends, b.exact) if b.exact is not None else None
    return _Known(
        None, left.starts if starts is None else frozenset(s[:2] for s in starts),
        right.ends if ends is None else frozenset(s[-2:] for s in ends), needs,
    )


def _either(parts: Sequence[_Known]) -> _Known:
    if all(p.exact is not None for p in parts):
        union = frozenset().union(*[p.exact for p in parts])
        if len(union) <= MOST_STRINGS:
            return _Known(union, union, union, ANY)
    opened = [_open(p) for p in parts]
    return _Known(
        None, frozenset().union(*[p.starts for p in opened]), frozenset().union(*[p.ends for p in opened]),
        _least(a for p in opened for a in p.needs),
    )


def _letter(code: int) -> _Known:
    """One character, in lower case as the index has it; others than ASCII may fold in several ways."""
    return _Known(*[frozenset({chr(code).lower()})] * 3, ANY) if code < 128 else _UNKNOWN


def _class(items: Sequence) -> _Known:
    codes: set[int] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            codes.add(value)
        elif str(kind) == "RANGE":
            codes.update(range(value[0], min(value[1], 127) + 2))  # one above ASCII marks a range that goes on
        else:
            return _UNKNOWN
    return _either([_letter(c) for c in sorted(codes)]) if len(codes) <= 16 and max(codes) < 128 else _UNKNOWN


def _repeated(low: int, high: int, part: _Known) -> _Known:
    if low == 0:
        return _Known(part.exact | _NOTHING, part.exact | _NOTHING, part.exact | _NOTHING, ANY) if high == 1 and part.exact is not None else _UNKNOWN
    if part.exact is not None and low == high <= 4:
        whole = part
        for _ in range(low - 1):
            whole = _then(whole, part)
        return whole
    return _open(part)


def _known(nodes: Iterable) -> _Known:
    whole = _Known(_NOTHING, _NOTHING, _NOTHING, ANY)
    for kind, value in nodes:
        name = str(kind)
        if name == "LITERAL":
            part = _letter(value)
        elif name == "IN":
            part = _class(value)
        elif name == "SUBPATTERN":
            part = _known(value[-1])
        elif name == "BRANCH":
            part = _either([_known(x) for x in value[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            part = _repeated(int(value[0]), int(value[1]), _known(value[2]))
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # takes no text
        else:
            part = _UNKNOWN
        whole = _then(whole, part)
    return whole


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams, one of which every text with a match has in full; ANY if none is mandatory."""
    return _open(_known(_syntax.parse(pattern))).needs


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, block and slot of every row as a stored table, whose rows have the same place for every reader."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = cut_lineage(rows)
    return rows.select("key", "text", F.shiftright("at", BLOCK_BITS).alias("block"), F.col("at").bitwiseAND((1 << BLOCK_BITS) - 1).alias("slot"))


def index(rows: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(gram, block, bits): the slots of each block whose text has the trigram. Rows of a block lie in one task, so a
    bitmap is complete before it is sent."""
    listed = F.array(*[F.lit(g) for g in grams])
    held = let(F.lower("text"), lambda low: F.filter(listed, lambda g: F.contains(low, g)))
    return rows.select("block", "slot", F.explode(held).alias("gram")).groupBy("gram", "block").agg(F.bitmap_construct_agg("slot").alias("bits"))


def candidates(postings: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(block, one bitmap per kind): rows of the block that may match the rule of that kind."""
    terms = [(kind, n, gram, len(term)) for kind, q in queries.items() for n, term in enumerate(sorted(q, key=sorted)) for gram in sorted(term)]
    listed = postings.sparkSession.createDataFrame(terms, "kind string, term int, gram string, need int")
    met = postings.join(F.broadcast(listed), "gram").groupBy("block", "kind", "term").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    kinds = met.filter("n = need").groupBy("block", "kind").agg(F.bitmap_or_agg("bits").alias("bits"))
    return kinds.groupBy("block").agg(*[F.first(F.when(F.col("kind") == k, F.col("bits")), ignorenulls=True).alias(f"may_{k}") for k in queries])


def _bit(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(slot, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, slot.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def _running(values: Column) -> Column:
    """Sums up to and with each value, in runs of about sqrt(n) so that no long list is copied for every value."""

    def sums(run: Column, before: Column) -> Column:
        added = F.aggregate(run, F.array(before), lambda got, x: F.array_append(got, F.element_at(got, -1) + x))
        return F.slice(added, F.lit(2), F.size(run))

    def joined(runs: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        totals = F.transform(runs, lambda run: F.aggregate(run, zero, lambda s, x: s + x))
        return F.flatten(F.zip_with(runs, F.concat(F.array(zero), sums(totals, zero)), lambda run, before: F.when(run.isNotNull(), sums(run, before)).otherwise(F.array().cast("array<bigint>"))))

    def cut(width: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(values), width), lambda i: F.slice(values, i, width)), joined)

    return let(F.ceil(F.sqrt(F.size(values))).cast("int"), cut)


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,secret:string>>"


def spans_of(text: Column, rule: Rule, rank: int = 0) -> Column:
    """Array of (start, rank, end, kind, secret) of the rule's matches in a text, by start."""
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    none = F.array().cast(_SPAN)

    def placed(found: Column, starts: Column, values: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(starts, i)
            return F.struct(
                start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(m)).alias("end"),
                F.lit(rule.kind).alias("kind"), F.get(values, i).alias("secret"),
            )

        long = F.filter(F.transform(found, span), lambda s: F.char_length(s["secret"]) >= rule.least)
        return long.cast(_SPAN)

    def located(found: Column) -> Column:
        sizes = F.transform(found, lambda m: F.char_length(m).cast("bigint"))
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("bigint"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(F.concat(F.array(F.lit(0).cast("bigint")), sizes), F.lit(1), F.size(found)), lambda g, s: g + s)
        values = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else found
        whole = let(steps, lambda st: let(_running(st), lambda starts: let(values, lambda v: placed(found, starts, v))))
        return F.when(F.size(found) > 0, whole).otherwise(none)

    # Without groups whose length counts, matches that are too short need no place of their own: they are plain text.
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), located)


def _narrow(rule: Rule) -> Rule:
    """The same spans from fewer matches, where a match is the rest of one run of a class: too short runs are not matched."""
    run = re.fullmatch(r"([A-Za-z0-9]*)(\[[A-Za-z0-9-]+\])\+", rule.pattern)
    if rule.value or rule.any_case or not run or not re.fullmatch(f"{run[2]}*", run[1]):
        return rule
    return rule._replace(pattern=f"{run[1]}{run[2]}{{{max(1, rule.least - len(run[1]))},}}")


def find(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``spans``, the array of (start, rank, end, kind, secret) of all rules by start, then rule, of every row."""
    rows = numbered(docs, key, text)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    if queries:
        grams = sorted({g for q in queries.values() for term in q for g in term})
        maybe = cut_lineage(candidates(index(rows, grams), queries))
        few = maybe.count() * len(queries) << (BLOCK_BITS - 3) <= MOST_SENT
        rows = rows.join(F.broadcast(maybe) if few else maybe, "block", "left")
    own = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), _narrow(rule), rank)
        if rule.kind in queries:
            spans = F.when(_bit(F.col(f"may_{rule.kind}"), F.col("slot")), spans).otherwise(F.array().cast(_SPAN))
        own.append(spans)
    return rows.select(F.col("key").alias(key), F.array_sort(F.concat(*own)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql_spans(rule: Rule, rank: int) -> str:
    """DuckDB's spans of one rule: pieces between matches and matches give the places."""
    pattern = (("(?i)" if rule.any_case else "") + rule.pattern).replace("'", "''")
    return f"""
  SELECT row, {rank} AS rank, '{rule.kind}' AS kind, starts[n] AS start, starts[n] + length(found[n]) AS stop
  FROM (
    SELECT row, found, vals, n, list_transform(range(1, len(found) + 1), lambda i:
      list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0)) AS starts
    FROM (
      SELECT row, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {rule.value}) AS vals,
        string_split_regex(text, '{pattern}') AS gaps
      FROM texts), LATERAL (SELECT unnest(range(1, len(found) + 1)) AS n))
  WHERE length(vals[n]) >= {rule.least}"""


SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(_narrow(r), n) for n, r in enumerate(RULES))}),
joined AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (row)"""


@query("op11_secrets", SQL)
def op11(spark, folder):
    rows = find(documents(spark, folder))
    counts = [F.size(F.filter("spans", lambda s: s["rank"] == n)).cast("bigint").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return rows.select(
        "doc_id", *counts, F.sha2(_listed(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
