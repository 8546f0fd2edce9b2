"""Every dealt operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns whose names clash with those the operators use."""

import zlib

import pytest
from pyspark.sql import functions as F

from lorescope.llm import language, lm, media, mixing, neardup, pieces, quality, sharding, tokenfiles, winnowing
from lorescope.session import scratch_path

LONG = " ".join(f"word{i % 997} the of und {i % 13}" for i in range(30_000))
CLASHING = ["score", "predicted", "held_out", "size", "copies", "rep", "comp", "id", "b", "key", "block", "chunk", "draw",
            "_draw", "ids", "Kind", "media", "next_text", "prefix", "c0", "a.b", "DEPTH"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "   \n\t ", "a", "a b", "12 34 !!", "a b c d e f g h", "a b c d e f g h", LONG, LONG + " end", "é ü ß 日本語 😀",
             "The cat sat on the mat and the dog sat on the log.", "x" * 5000]
    rows = [(i, t, "en" if i % 3 else None, "src" if i % 2 else None, 1) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "a b c d e f g h", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(11, 1, 0), (5, 0, 0), (7, 1, 0), (7, 1, 1), (4, None, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(spark, odd, labels):
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["score"] for r in rows}
    assert found[0] == found[1]  # NULL counts as empty
    assert quality.keep_good(odd, model, 0.0).schema == odd.schema
    assert quality.keep_good(odd, model, 0.0).count() == odd.count()
    none = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


def test_language(odd):
    model = language.fit(odd)
    rows = by_id(language.predict(odd, model))
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 5))
    assert rows[8]["lang_pred"] == "en"
    kept = language.keep_known(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.filter("text is null or text = ''").count() == 0
    nothing = language.fit(odd.limit(0))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}


def test_language_tie_goes_to_the_first(spark):
    rows = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(rows, language.fit(rows)).collect()} == {"a"}


def test_neardup(odd):
    rows = neardup.classes(odd, words=4).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows}
    assert [found[i]["n_shingles"] for i in (0, 1, 2, 3, 4, 6)] == [0, 0, 0, 1, 1, 5]
    assert all(found[i]["component_id"] == i for i in (0, 1, 2, 3, 4, 5, 6, 8)) and found[7]["component_id"] == 6
    assert found[9]["component_id"] == 8 and not found[9]["kept"]
    assert found[None]["component_id"] is None and found[None]["kept"]
    kept = neardup.keep_one(odd, words=4)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12] and ids.count(None) == 2
    assert neardup.classes(odd.limit(0)).count() == 0


def test_neardup_of_an_id_with_several_texts(spark):
    """Whatever the order of its rows, all texts of an id link, and its rows share one component."""
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    third = " ".join(f"u{i}" for i in range(40))
    rows = [(1, words), (1, other), (2, words + " zz"), (3, other + " yy"), (5, third), (5, ""), (5, other), (6, third), (6, third), (7, "")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        found = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(docs, words=4).collect()}
        assert found == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (6, 1, False), (7, 7, True)}
        assert sorted(r["doc_id"] for r in neardup.keep_one(docs, words=4).collect()) == [1, 7]


def test_language_sample_is_not_filled_by_tiny_texts_or_copies(spark):
    prose = {x: [(" ".join(f"{x}{(i * j) % 97}word{x}" for j in range(60))).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40)] for x in "pq"}
    rows = [(t, x) for x in "pq" for t in prose[x]] + [(f"ok {i}", "p") for i in range(1000)] + [(prose["q"][0], "q")] * 500
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").selectExpr("1L as doc_id", "text", "lang"))
    assert (2**model.bits > 0.9 * language.SAMPLE_BYTES).all()
    tiny = language.fit(spark.createDataFrame([(1, f"{chr(97 + i % 26)}{chr(97 + i // 26)} some words", "p") for i in range(600)], "doc_id long, text string, lang string"))
    assert 2 ** tiny.bits[0] > 6000  # all of them, as nothing else is there


def test_language_table_is_bounded_over_many_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j % 26)}" for j in range(200)) * 8, f"lang{i:03}") for i in range(200)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 200 and (2**model.bits).sum() <= language.ALL_BYTES + 200
    assert len(model.table) <= 2 * language.ALL_BYTES * (len(model.symbol) + 1) and model.table.min() >= 0


def test_short_texts_are_not_dropped_for_fitting_several_languages(spark):
    short = ["a", "e", "Hi!", "OK", "no", "the", "name", "12", "", None]
    docs = spark.createDataFrame([(i, "the name of the one " * 20, f"l{i}") for i in range(4)] + [(10 + i, t, None) for i, t in enumerate(short)],
                                 "doc_id long, text string, lang string")
    kept = [r["doc_id"] for r in language.keep_known(docs, language.fit(docs), 0.4, few=32).collect()]
    assert sorted(i for i in kept if i >= 10) == list(range(10, 17))


def test_mixing(odd):
    rows = mixing.mixed_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert taken <= 3 * own[0]["source_size"] and own[0]["source_size"] == sum(r["size"] for r in own)
    out = mixing.mixture(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_sources(odd).collect()))
    assert mixing.mixed_sources(odd.limit(0)).count() == mixing.mixture(odd.limit(0)).count() == 0


def test_pieces(odd):
    model = pieces.model_bytes()
    rows = pieces.decode(pieces.encode(odd, model), model).collect()
    assert len(rows) == odd.count()
    truth, texts = pieces.Codec(model, 1).truth, by_id(odd)
    for r in rows:
        text = texts[r["doc_id"]]["text"] or ""
        if r["doc_id"] is not None:
            assert r["ids"] == truth.encode(text) and r["decoded"] == text
        assert r["parity"] and r["round_trip"]
    assert pieces.encode(odd.limit(0), model).count() == 0


def test_sharding(odd):
    rows = sharding.shard(odd, limit=50_000).collect()
    assert len(rows) == odd.count()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for name, own in shards.items():
        assert len(name) == own[0]["depth"] and own[0]["shard_rows"] == len(own)
        assert own[0]["shard_bytes"] == sum(r["n_bytes"] for r in own)
        assert own[0]["fits"] == (own[0]["shard_bytes"] <= 50_000)
        assert own[0]["fits"] or len(own) == 1
    assert sharding.shard(odd.limit(0)).count() == 0


def test_rows_of_one_key_stay_together(spark):
    rows = spark.createDataFrame([(1, "abc")] * 5 + [(2, "abc")], "doc_id long, text string")
    found = by_id(sharding.shard(rows, limit=4))
    assert found[1]["shard_rows"] == 5 and not found[1]["fits"] and found[1]["depth"] == sharding.BITS and found[2]["fits"]


def test_token_counts(spark, odd):
    import tiktoken

    place = scratch_path(spark, "tokens")
    order = tokenfiles.write_tokens(odd, place, tokenfiles.read_ranks())
    texts = by_id(odd)
    coder = tiktoken.Encoding("own", pat_str=tokenfiles.PATTERN, mergeable_ranks=tokenfiles.read_ranks(), special_tokens={})
    for block in (1 << 20, 7):  # small blocks cut documents many times
        rows = tokenfiles.document_lengths(spark, place, block=block).join(order, ["file", "nth"]).collect()
        assert len(rows) == odd.count()
        for r in rows:
            if r["doc_id"] is not None:
                assert r["n_tokens"] == len(coder.encode_ordinary(texts[r["doc_id"]]["text"] or ""))
    empty = scratch_path(spark, "tokens")
    assert tokenfiles.write_tokens(odd.limit(0), empty, tokenfiles.read_ranks()).count() == 0
    assert tokenfiles.document_lengths(spark, empty).count() == 0


def test_media(odd):
    rows = media.media_features(media.texts_as_media(odd), ["doc_id", "n_bytes"])
    found = rows.collect()
    assert len(found) == odd.count() and all(r["samples"] % 576 == 0 and r["samples"] > 0 for r in found)
    own = {r["doc_id"]: r for r in found}
    assert own[0]["samples_sha256"] == own[1]["samples_sha256"] and own[6]["media_sha256"] == own[7]["media_sha256"]
    assert zlib.crc32(own[0]["tail"]) == zlib.crc32(b"\xff" * 32)
    assert media.media_features(media.texts_as_media(odd.limit(0)), ["doc_id"]).count() == 0


def test_winnowing(spark, odd):
    rows = winnowing.with_next(odd, {"print": winnowing.fingerprint(F.col("text"))})
    found = rows.collect()
    assert len(found) == odd.count() and all(r["next_text"] is not None for r in found)
    prints = {}
    for r in found:
        prints.setdefault(r["text"], set()).add(str(r["print"]))
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == prints["   \n\t "] == {"[]"}
    assert winnowing.with_next(odd.limit(0), {}).count() == 0
    alone = winnowing.with_next(odd.filter("doc_id = 3"), {}).collect()
    assert [(r["text"], r["next_text"]) for r in alone] == [("a", "a")]


def test_lm(odd, tmp_path):
    odd.write.parquet(str(tmp_path / "docs"))
    docs = odd.sparkSession.read.parquet(str(tmp_path / "docs"))
    rows = lm.score(docs, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and r["base_score"] <= 0 for r in rows)
    found = {r["doc_id"]: r for r in rows}
    assert found[0]["n_tokens"] == found[1]["n_tokens"] == 1 and found[0]["score"] == found[1]["score"]
    assert found[6]["score"] == found[7]["score"] and found[None]["learned"] is False
    nothing = lm.score(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in nothing)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_held_out_rows_without_an_id(odd):
    for module in (quality, language, lm):
        assert odd.select(module.held_out().alias("h")).filter("h is null").count() == 0
