"""The pipeline, stage by stage, against brute force on what each stage got."""

import collections

import pytest
from test_edges import odd  # noqa: F401  (a fixture)
from test_results import SMALL, WORD, near_classes

import corpus_pipeline
from lorescope.llm import pieces
from lorescope.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut_lineage(stage(spark, docs, SMALL))
    return {name: df.collect() for name, df in out.items()}


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)[1:]
    for name in list(stages)[:-1]:
        assert list(stages[name][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark, stages):
    kept = set(ids(stages["quality"]))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    good, bad = ([r["doc_id"] in kept for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_language_keeps_clean_documents(stages):
    assert len(stages["language"]) >= 0.99 * len(stages["quality"])


def test_one_of_each_group(stages):
    _, root = near_classes({r["doc_id"]: r["text"] for r in stages["language"]}, 5)
    assert sorted(ids(stages["near-duplicates"])) == sorted(i for i, r in root.items() if i == r)


def test_mix(stages):
    before, after = stages["near-duplicates"], collections.Counter(ids(stages["mixing"]))
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    assert set(after) <= set(size) and max(after.values()) <= 3
    assert abs(sum(size[i] * n for i, n in after.items()) - sum(size.values())) <= 200


def test_tokens(stages):
    truth = pieces.Codec(pieces.model_bytes(), 1).truth
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"]}
    assert sorted(ids(stages["tokens"])) == sorted(ids(stages["mixing"]))
    for r in stages["tokens"]:
        assert r["ids"] == truth.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_stages_on_odd_rows(spark, odd):
    rows = odd
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, SMALL)
        if name != "tokens":
            assert got.columns == odd.columns
            assert got.count() <= (3 if name == "mixing" else 1) * rows.count()
        rows = cut_lineage(got) if name != "tokens" else got
    assert rows.count() >= 0 and rows.columns == ["doc_id", "n_tokens", "ids"]
