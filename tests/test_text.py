"""Text and verdict parsing on hand-made cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorescope.functions import text as X
from lorescope.functions.pycalls import library_calls
from lorescope.functions.wikidata import ALLOWED_PROPS, OBJECT_RULES, SUBJECT_RULES, TEMPLATES
from lorescope.operators import mining as Q


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def test_strip_follows_python(spark):
    texts = ["  a b 　\n", "", " \t", "x", "\x1c y \x85", "​ z"]
    assert values(spark, texts, X.strip) == [t.strip() for t in texts]


def test_words_follow_python_split(spark):
    texts = ["a b  c\n", "", "  ", "one", " two\x1cthree "]
    assert values(spark, texts, X.words) == [t.split() for t in texts]
    assert values(spark, texts, X.word_count) == [len(t.split()) for t in texts]


def test_verdict_modes(spark):
    texts = ["Yes,", "I say yes", "Equivalence: Yes", "Correct: yes it is", "no", "", "  YES"]
    assert values(spark, texts, lambda c: X.verdict(c, "prefix")) == [True, False, True, True, False, False, True]
    assert values(spark, texts, lambda c: X.verdict(c, "contains")) == [True, True, True, True, False, False, True]
    with pytest.raises(ValueError):
        X.verdict(F.lit(""), "other")


def test_nli_precedence(spark):
    texts = ["not entailment", "Contradiction, no ENTAILMENT", "contradiction", "NLI: neutral", ""]
    assert values(spark, texts, X.nli_class) == ["entailment", "entailment", "contradiction", "neutral", "neutral"]


def test_token_is_exact(spark):
    texts = ["No.", "I say No here", "no", "No", "No way", "Nothing", ""]
    assert values(spark, texts, lambda c: X.has_token(c, "No")) == ["No" in t.split() for t in texts]


def test_code_block(spark):
    two = "x ```python\na = 1\n``` y ```python\nb\n```"
    texts = [two, " none ", "```python\nopen", "```python\n\n```"]
    assert values(spark, texts, X.code_block) == ["a = 1", "none", "```python\nopen", ""]
    assert values(spark, texts, lambda c: X.code_block(c, "answer")) == ["a = 1", "N/A", "N/A", ""]


def test_final_line(spark):
    texts = ["a\n b \n \n  \n", "", "\n\n", "one"]
    assert values(spark, texts, X.final_line) == ["b", "", "", "one"]


def test_next_subquestion(spark):
    texts = ["t\n[Next Subquestion]  Who?\nmore", "Who is it?", "two\nlines?", "no question", "[Next Subquestion]\n\n Why? \n", "[Next Subquestion]"]
    assert values(spark, texts, X.next_subquestion) == ["Who?", "Who is it?", None, None, "Why?", ""]


def test_after_think(spark):
    assert values(spark, ["a</think>b</think> c ", " plain "], X.after_think) == ["c", "plain"]


def test_split_concepts(spark):
    assert values(spark, [" a, b ,, c", " , "], X.split_concepts) == [["a", "b", "c"], []]


def test_strip_backticks(spark):
    texts = ["`f(x)`", "```python\nf(x)\n```", "f(`x`)", " `a "]
    assert values(spark, texts, X.strip_backticks) == ["f(x)", "f(x)", "f(`x`)", "`a"]


def test_one_decimal_halves(spark):
    numbers = [18.25, 18.75, 0.0, 100.0, 12.34, 12.36, 0.25]
    rows = spark.createDataFrame([(n,) for n in numbers], "x double")
    assert [r[0] for r in rows.select(X.one_decimal(F.col("x"))).collect()] == [f"{n:.1f}" for n in numbers]


def test_canonical_call(spark):
    df = spark.sql("""SELECT 'f' AS f, array('a', 'b') AS p, array(named_struct('name', 'k', 'value', '1')) AS n
        UNION ALL SELECT 'g', array(), array(named_struct('name', '**kw', 'value', ''))
        UNION ALL SELECT 'h', array(), CAST(array() AS ARRAY<STRUCT<name: STRING, value: STRING>>)""")
    out = {r[0] for r in df.select(X.canonical_call(F.col("f"), F.col("p"), F.col("n"))).collect()}
    assert out == {"f(a, b, k=1)", "g(, **kw=)", "h()"}


@pytest.mark.parametrize(
    "code, expected",
    [
        ("import numpy as np\nnp.a.b(1, k=2)", [("numpy", "numpy.a.b", ["1"], [("k", "2")])]),
        ("import numpy as np\nnumpy.zeros(3)", [("numpy", "numpy.zeros", ["3"], [])]),
        ("import numpy, numpy as np\nnumpy.zeros(3)", [("numpy", "numpy.zeros", ["3"], [])]),
        ("import os.path\nos.path.join('a')", []),
        ("import os\nos.path.join('a', *b)", [("os", "os.path.join", ["'a'", "*b"], [])]),
        ("from a.b import c as d\nd(1)\nd.e(**kw)", [("a", "a.b.c", ["1"], []), ("a", "a.b.c.e", [], [("**kw", "")])]),
        ("from . import x\nx.f()", []),
        ("import m\nm.f(m.g(1))", [("m", "m.f", ["m.g(1)"], []), ("m", "m.g", ["1"], [])]),
        ("import m\nm.f().g()", [("m", "m.f", [], [])]),
        ("f(1)\nimport f", []),
        ("m.f()\nimport m\nm.g()", [("m", "m.g", [], [])]),
    ],
)
def test_library_calls(code, expected):
    assert [tuple(c) for c in library_calls(code)] == expected


def test_unreadable_code_is_an_error_row():
    assert Q.call_rows("def (:")[0][-1] == "SyntaxError"
    assert Q.call_rows("a = \x00")[0][-1] in ("SyntaxError", "ParsingError")


def test_generalize_args(spark):
    cases = [
        (["x", "y"], ["a", "b"], ["a", "b"]),
        (["x", "y", "z"], ["a", "*rest"], ["a", "rest_0", "rest_1"]),
        (["x", "y", "z"], ["a"], ["a", "<pos_arg_2>", "<pos_arg_3>"]),
        (["x", "y"], ["<param0_doc_fallback>"], ["x", "<pos_arg_2>"]),
        (["x"], ["<fetch_failed_phase1>"], ["x"]),
        (["x"], None, ["x"]),
        ([], ["a"], []),
        (["x"], [], ["<pos_arg_1>"]),
    ]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _) in enumerate(cases)], "i int, a array<string>, p array<string>")
    out = [r[0] for r in df.orderBy("i").select(Q.generalize_args(F.col("a"), F.col("p"))).collect()]
    assert out == [e for _, _, e in cases]


def python_kqa(text):
    pattern = r"Knowledge: (.*?)\nQuestion: (.*?)\nAnswer: (.*?)(?=\nKnowledge:|\Z)"
    found = [tuple(g.strip() for g in m.groups()) for m in re.finditer(pattern, text, re.DOTALL)]
    return [f for f in found if all(f)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Knowledge: ", "\nKnowledge: ", "\nQuestion: ", "\nAnswer: ", "k", " ", "\n", "q a"]), max_size=14), min_size=30, max_size=30))
def test_parse_kqa_follows_pattern(spark, parts):
    texts = ["".join(p) for p in parts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[] for _ in texts]
    for r in Q.parse_kqa(rows, "t").collect():
        got[r["i"]].append((r["knowledge"], r["question"], r["answer"]))
    assert [sorted(g) for g in got] == [sorted(python_kqa(t)) for t in texts]


def test_parse_kqa_is_linear(spark):
    import time

    blocks = "".join(f"\nKnowledge: k{i}\nQuestion: q{i}" for i in range(800))
    rows = spark.createDataFrame([(1, blocks), (2, blocks + "\nAnswer: a")], "i int, t string").cache()
    rows.count()
    Q.parse_kqa(rows.limit(0), "t").count()
    start = time.time()
    found = Q.parse_kqa(rows, "t").collect()
    assert time.time() - start < 5
    assert [(r["i"], r["answer"]) for r in found] == [(2, "a")] and found[0]["knowledge"] == "k0"


def test_parse_kqa_of_many_blocks(spark):
    """6400 complete blocks in one text take well under a second; the time does not grow with their square."""
    import time

    texts = {n: "".join(f"\nKnowledge: k{i}\nQuestion: q{i}\nAnswer: a{i}" for i in range(n)) for n in (6400, 64000)}
    took = {}
    for n, text in texts.items():
        start = time.perf_counter()
        assert sum(1 for _ in Q.kqa_spans(text)) == n
        took[n] = time.perf_counter() - start
    assert took[6400] < 0.5 and took[64000] < 30 * max(took[6400], 0.01)
    found = Q.parse_kqa(spark.createDataFrame([(1, texts[6400])], "i int, t string"), "t").collect()
    assert [(r["knowledge"], r["question"], r["answer"]) for r in found] == [(f"k{i}", f"q{i}", f"a{i}") for i in range(6400)]


def test_two_corrections_do_not_double_a_fact(spark):
    facts = spark.createDataFrame([(1, "a", "k", "No wrong"), (2, "b", "k", "Yes right")], "i int, answer string, knowledge string, verdict string")
    fixes = spark.createDataFrame([(1, "z", "new"), (1, "y", "newer"), (3, "q", "other")], "i int, corrected_answer string, corrected_knowledge string")
    rows = sorted(tuple(r) for r in Q.apply_corrections(facts, fixes, ["i"]).select("i", "answer", "knowledge", "corrected").collect())
    assert rows == [(1, "y", "newer", True), (2, "b", "k", False)]


def test_a_docstring_that_is_not_there_falls_back(spark):
    calls = spark.createDataFrame([("f", ["x"], [])], "function string, positional_args array<string>, keyword_args array<struct<name string, value string>>")
    for doc, want in (("N/A", "f(a)"), ("  ", "f(a)"), ("Does.", "Does.")):
        catalog = spark.createDataFrame([("f", "f(a)", ["a"], doc)], "function string, signature_string string, positional_params array<string>, docstring string")
        assert Q.call_knowledge(calls, catalog).first()["docstring"] == want


def test_property_tables_agree():
    assert len(ALLOWED_PROPS) == 36 and "P30" not in ALLOWED_PROPS
    assert set(SUBJECT_RULES) | set(OBJECT_RULES) <= set(ALLOWED_PROPS)
    for question, cloze, attributive in TEMPLATES.values():
        assert "[S]" in question and "[S]" in attributive and "[S]" in cloze and cloze.count("___") == 1
