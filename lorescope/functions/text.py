"""Text and verdict parsing as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x1c-\x1f]"
_CODE = r"(?U)```python\s*([\s\S]*?)\s*```"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty or blank text gives an empty array."""
    return F.filter(F.split(text, f"(?U){_WS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def clean_response(text: Column) -> Column:
    return strip(F.replace(text, F.lit("Assistant:"), F.lit("")))


def code_block(text: Column, stage: str = "probe") -> Column:
    """First fenced Python block; without one, the stripped text or 'N/A' by stage."""
    found = strip(F.get(F.regexp_extract_all(text, F.lit(_CODE), 1), F.lit(0)))
    if stage == "probe":
        return F.coalesce(found, strip(text))
    if stage == "answer":
        return F.coalesce(found, F.lit("N/A"))
    raise ValueError(f"unknown stage {stage!r}")


def final_line(text: Column) -> Column:
    """Last line that is not blank, stripped; '' when there is none."""
    return F.coalesce(strip(F.substring_index(strip(text), "\n", -1)), F.lit(""))


def verdict(text: Column, mode: str = "prefix") -> Column:
    """Yes/no reading of a judge's reply.

    ``prefix`` wants the reply to start with yes, ``contains`` takes it anywhere.
    """
    bare = F.replace(text, F.lit("Equivalence:"), F.lit(""))
    if mode == "prefix":
        bare = F.replace(bare, F.lit("Correct:"), F.lit(""))
        return F.startswith(F.lower(strip(bare)), F.lit("yes"))
    if mode == "contains":
        return F.contains(F.lower(bare), F.lit("yes"))
    raise ValueError(f"unknown mode {mode!r}")


def verdict_explanation(text: Column) -> Column:
    bare = F.replace(text, F.lit("Equivalence:"), F.lit(""))
    return strip(F.replace(bare, F.lit("Correct:"), F.lit("")))


def binary_label(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("yes")).cast("int")


def nli_class(text: Column) -> Column:
    """Entailment beats contradiction beats neutral, by substring."""
    low = F.lower(F.replace(text, F.lit("NLI:"), F.lit("")))
    return (
        F.when(F.contains(low, F.lit("entailment")), "entailment")
        .when(F.contains(low, F.lit("contradiction")), "contradiction")
        .otherwise("neutral")
    )


def has_token(text: Column, token: str) -> Column:
    """Whether ``token`` is one of the whitespace-separated words, exactly."""
    return F.array_contains(F.split(text, f"(?U){_WS}+"), token)


def next_subquestion(text: Column) -> Column:
    """The line after the subquestion tag, or a one-line question, or NULL."""
    text = strip(text)
    tagged = F.get(F.regexp_extract_all(text, F.lit(r"(?Us)\[Next Subquestion\]\s*(.*)"), 1), F.lit(0))
    one_line = F.contains(text, F.lit("?")) & ~F.contains(text, F.lit("\n"))
    return F.coalesce(F.substring_index(strip(tagged), "\n", 1), F.when(one_line, text))


def after_think(text: Column, marker: str = "</think>") -> Column:
    """What follows the last end-of-thinking marker; all of it without one."""
    return strip(F.substring_index(text, marker, -1))


def split_concepts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda c: c != "")


def strip_backticks(text: Column) -> Column:
    """Unwrap an answer quoted in backticks, dropping a language tag."""
    bare = strip(text)
    inner = strip(F.replace(F.btrim(bare, F.lit("`")), F.lit("python"), F.lit("")))
    quoted = F.startswith(bare, F.lit("`")) & F.endswith(bare, F.lit("`"))
    return F.when(quoted, inner).otherwise(bare)


def canonical_call(function: Column, positional: Column, keywords: Column) -> Column:
    """``f(a, b, k=v)`` from its parts; keywords is an array of (name, value)."""
    named = F.array_join(F.transform(keywords, lambda kv: F.concat(kv["name"], F.lit("="), kv["value"])), ", ")
    return F.concat(
        function,
        F.lit("("),
        F.array_join(positional, ", "),
        F.when(F.size(keywords) > 0, F.concat(F.lit(", "), named)).otherwise(""),
        F.lit(")"),
    )


def one_decimal(value: Column) -> Column:
    """A number with one decimal; halves go to the even digit, as Python formats them.

    Noise beyond six decimals is removed first, so that a half is recognised.
    """
    return F.format_string("%.1f", F.bround(F.round(value, 6), 1))
