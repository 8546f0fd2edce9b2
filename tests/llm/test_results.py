"""The dealt queries on the shared tables, against brute force, round trips, SQL or held-out labels."""

import collections
import hashlib
import io
import itertools
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from harness import compare
from pyspark.sql import functions as F

from lorescope.llm import catalog, language, media, mixing, neardup, pieces, quality, sharding, winnowing

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}


def near_classes(texts, words, percent=80):
    """Shingle sets and the smallest id of each component, by comparing every two sets that share a shingle."""
    sets = {}
    for i, text in texts.items():
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for g in sets[i] for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders[g].append(i)
    return sets, {i: find(i) for i in sets}


def test_quality_of_held_out_documents(spark):
    rows = catalog.QUERIES["op1_quality"](spark, SMALL)
    assert set(rows.columns) == {"doc_id", "held_out", "score", "predicted"}
    marked = rows.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    for r in marked:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in marked if r["held_out"]]
    good, bad = ([r for r in held if r["quality"] == q] for q in (1, 0))
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good) and sum(r["predicted"] for r in bad) <= 0.2 * len(bad)
    pairs = [(g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.98


def test_isotonic_blocks():
    grid = np.array([[2, 1, 0, 1, 4.0], [1, 0, 0, 1, 4], [0, 0.3, 0, 0.6, 4]])
    levels, shares = quality.isotonic(grid)
    assert np.allclose(shares, [1 / 3, 1]) and np.allclose(levels, [0.1, 0.92])


def test_quality_against_one_fit(spark):
    """Weights, calibration and scores of the summed form are those of one fit over all labelled rows in memory."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels, learn=~quality.held_out())
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marked = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in rows]
    marked = [(i, q) for i, q in marked if zlib.crc32(str(i).encode()) % 5]
    stats = quality.statistics(pa.array([rows[i] for i, _ in marked])).astype(np.float64)
    y, fold = np.array([q for _, q in marked], float), np.array([zlib.crc32(f"fold{i}".encode()) % quality.FOLDS for i, _ in marked])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(stats.var(0), 1e-8)), rtol=1e-4)
    z = model.fourier(stats)

    def ridge(use):
        return np.linalg.solve(z[use].T @ z[use] + quality.RIDGE * use.sum() * np.eye(z.shape[1]), z[use].T @ y[use])

    assert np.allclose(model.weights, ridge(np.ones(len(y), bool)), atol=1e-6)
    out = np.empty(len(y))
    for f in np.unique(fold):
        out[fold == f] = z[fold == f] @ ridge(fold != f)
    cell = np.clip((out + 0.5) / 2 * quality.GRID, 0, quality.GRID - 1).astype(int)
    used = np.unique(cell)
    n, ones = (np.concatenate([[0], np.cumsum([v[cell == c].sum() for c in used])]) for v in (np.ones(len(y)), y))
    share = lambda a, b: (ones[b + 1] - ones[a]) / (n[b + 1] - n[a])
    k = range(len(used))
    rising = [max(min(share(a, b) for b in k[i:]) for a in k[: i + 1]) for i in k]
    assert np.allclose(np.unique(np.round(rising, 9)), np.unique(np.round(model.shares, 9)))
    raw = {i: float(x) for i, x in zip(rows, model.raw(quality.statistics(pa.array(list(rows.values())))))}
    for r in catalog.QUERIES["op1_quality"](spark, SMALL).collect():
        x = raw[r["doc_id"]]
        want = 0.995 * np.interp(x, model.levels, model.shares) + 0.005 / (1 + math.exp(-x))
        assert abs(r["score"] - min(max(want, 0), 1)) < 1e-3


def test_language_of_held_out_documents(spark):
    rows = catalog.QUERIES["op6_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_phrases_by_brute_force():
    rng = np.random.default_rng(2)
    samples = {x: bytes(rng.choice(list(b"abc "), 300)) for x in ("p", "q")}
    model = language.Model.of(samples)
    found = [bytes(rng.choice(list(b"abcd "), n)) for n in (1, 7, 300, 256, 513)]
    raw = np.frombuffer(b"".join(found), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    for row, text in zip(model.phrases(raw, at), found):
        for name, got in zip(model.languages, row):
            n = 0
            for s in range(0, len(text), language.STRETCH):
                piece, phrase = text[s : s + language.STRETCH], b""
                for c in piece:
                    if phrase + bytes([c]) in samples[name]:
                        phrase += bytes([c])
                    else:
                        n += 1
                        phrase = bytes([c]) if bytes([c]) in samples[name] else b""
                n += bool(phrase)
            assert got == n


def test_near_duplicates_by_brute_force(spark, texts):
    sets, root = near_classes(texts, 4)
    rows = catalog.QUERIES["op10_neardup"](spark, TINY).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}


def test_copies_near_the_threshold(spark):
    """One large group whose members are around the threshold from each other, so that centres alone do not settle it."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        texts[i] = " ".join(words)
    _, root = near_classes(texts, 5)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs).collect()}
    assert found == root and 1 < len(set(root.values())) < 150


def test_mix_meets_its_targets(spark, texts):
    rows = catalog.QUERIES["op3_mixing"](spark, TINY).collect()
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    whole = collections.Counter()
    for i, n in size.items():
        whole[sources[i]] += n
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(whole))}
    goal, free = {}, set(whole)
    while True:  # share, cut at three times the source, share the excess again
        left = sum(whole.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * whole[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 3.0 * whole[s] for s in over}
        free -= over
    taken = collections.Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[s] and abs(r["target"] - goal[s]) < 1e-6 * goal[s]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(texts)
    for s in whole:  # no choice of its ten documents, each taken once more or not, comes nearer
        sums = {0}
        for i in size:
            if sources[i] == s:
                sums |= {x + size[i] for x in sums}
        rest = goal[s] - int(goal[s] / whole[s] + 1e-9) * whole[s]
        assert abs(taken[s] - goal[s]) <= min(abs(x - rest) for x in sums) + 1


def test_knapsack_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 6)))
        counts = rng.integers(1, 5, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 5))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {x + s * k for x in reach for k in range(c + 1)}
        for window in (mixing.WINDOW, 64):  # the smaller one takes shares and long sizes first
            take = mixing.fitted(sizes, counts, budget, window)
            assert (take >= 0).all() and (take <= counts).all()
            if window == mixing.WINDOW:
                assert (sizes * take).sum() == min(reach, key=lambda x: (abs(x - budget), x))


def test_knapsack_in_bounded_memory():
    """6000 even lengths and an odd budget, which no choice meets; and more steps than lie between two kept tables."""
    import tracemalloc

    sizes = np.arange(2, 12_002, 2)
    counts = np.full(len(sizes), 3)
    budget = int((sizes * counts).sum()) // 2 + 1
    budget += 1 - budget % 2
    tracemalloc.start()
    take = mixing.fitted(sizes, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int((sizes * take).sum()) == budget - 1 and take.max() <= 3 and peak < 20_000_000
    few = np.arange(7, 2_000, 13)  # more steps than lie between two kept tables
    take = mixing.fitted(few, np.full(len(few), 40), 1_234_567)
    assert int((few * take).sum()) == 1_234_567 and take.max() <= 40


def _field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_a_unigram_model_with_byte_fallback():
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    listed += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("▁t", -4.0, 1), ("he", -3.5, 1), ("h", -6.0, 1), ("e", -5.0, 1), ("t", -5.5, 1), ("▁he", -3.0, 1), ("re", -3.2, 1), ("r", -6.0, 1)]
    model = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in listed)
    model += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0) + _field(5, 1))
    codec = pieces.Codec(model, 1)
    assert codec.spec.unigram and codec.spec.byte_fallback
    lines = ["the there he", "her the é the", " the", "th  e", ""]
    ids, _ = codec.encode(lines)
    ids = [np.frombuffer(x, np.int32).tolist() for x in ids]
    assert ids == [codec.truth.encode(x) for x in lines]
    flat = np.array(sum(ids, []), np.int64)
    assert codec.decode(flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])])) == lines
    whole = codec.spec.tokenizer()
    assert [whole.encode(x, add_special_tokens=False).ids for x in lines[:2]] == ids[:2]


def _squeezing_model():
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁the", -1.0, 1), ("▁", -3.0, 1), ("the", -2.5, 1), ("t", -5.0, 1), ("h", -5.5, 1), ("e", -5.2, 1)]
    model = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, t)) for p, s, t in listed)
    return model + _field(2, _field(3, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))


def test_a_model_that_squeezes_blanks(spark):
    """Its rebuilt normaliser works on whole texts; ids and decoded texts are sentencepiece's, and what was squeezed makes no round trip."""
    model = _squeezing_model()
    codec = pieces.Codec(model, 1)
    assert not codec.by_segment and codec.spec.squeeze
    lines = {"the the": True, "the  the": False, "  the ": False, "the": True, "": True, "hat he": False}
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pieces.decode(pieces.encode(rows, model), model).collect()}
    for k, (line, same) in enumerate(lines.items()):
        r = found[k]
        assert r["parity"] and r["ids"] == codec.truth.encode(line) and r["round_trip"] == same == (r["decoded"] == line)
        assert r["decoded"] == codec.truth.decode(r["ids"])


def test_pieces_of_whole_texts(spark, texts):
    """Ids put together from segments are those of both libraries for whole texts, and decode to the texts by both."""
    model = pieces.model_bytes()
    codec = pieces.Codec(model, 1)
    extra = ["a ", " a", "a  b   c ", "▁", "a▁b", " ", "  ", "a\tb\n c", "<unk> <s>", "<0x41>", "\u2047 é😀"]
    docs = {**texts, **{-1 - k: x for k, x in enumerate(extra)}}
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    found = pieces.decode(pieces.encode(rows, model), model).collect()
    assert len(found) == len(docs)
    own = codec._backend_ids([docs[r["doc_id"]] for r in found])
    for r, ids in zip(found, own):
        text = docs[r["doc_id"]]
        assert r["ids"] == codec.truth.encode(text) and r["decoded"] == codec.truth.decode(r["ids"])
        assert r["parity"] and (not text or r["ids"] == ids) and r["round_trip"] == (r["decoded"] == text) == ("▁" not in text)


def test_segments_on_which_the_libraries_differ():
    """Sentencepiece's ids replace the backend's, and parity is false for texts with such a segment alone."""
    codec = pieces.Codec(pieces.model_bytes(), 1)
    backend = codec._backend_ids

    def wrong(lines):
        return [x[::-1] if "zebra" in line else x for line, x in zip(lines, backend(lines))]

    codec._backend_ids = wrong
    lines = ["a zebra ran", "a horse ran"]
    ids, parity = codec.encode(lines)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids] == codec.truth.encode(lines) and parity == [False, True]


@pytest.mark.parametrize("limit", [sharding.LIMIT, 60_000, 9_000])
def test_shards_against_sql(spark, limit):
    rows = sharding.shard(spark.read.parquet(f"{SMALL}/documents.parquet"), limit=limit)
    assert compare(rows, sharding.SQL.replace(str(sharding.LIMIT), str(limit)), SMALL) == ""


def test_token_counts(spark, texts):
    import tiktoken

    from lorescope.llm import tokenfiles as T

    coder = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.read_ranks(), special_tokens={})
    found = {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["op7_token_counts"](spark, TINY).collect()}
    assert found == {i: len(coder.encode_ordinary(t)) for i, t in texts.items()}


def test_media_round_trip(spark, texts):
    rows = catalog.QUERIES["op8_media"](spark, TINY).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = media.stored(payload)
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()


def test_image_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decoded(media.netpbm(grey)) == grey).all() and (media.decoded(media.netpbm(colour)) == colour).all()
    assert (media.decoded(media.bmp(colour)) == colour).all()
    plain = b"P2 # a comment\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()
    assert (media.decoded(plain) == grey).all()
    assert media.decoded(b"P5\n2 1\n100\n" + bytes([0, 50])).tolist() == [[0, 128]]
    top_down = bytearray(media.bmp(colour))
    top_down[22:26] = struct.pack("<i", -5)
    assert (media.decoded(bytes(top_down)) == colour[::-1]).all()
    for broken in (None, b"", b"GIF89a", b"P5\n9 9\n255\nxx", media.bmp(colour)[:60], b"BM"):
        assert media.decoded(broken) is None


def test_areas_against_the_definition():
    pixels = np.random.default_rng(5).integers(0, 256, (7, 5)).astype(np.float64)
    fine = np.kron(pixels, np.ones((8 * 3, 9 * 3)))  # every cell edge falls on a fine pixel
    want = fine.reshape(8, 21, 9, 15).mean((1, 3))
    assert np.allclose(media.area_resized(pixels, 8, 9), want)
    tile = np.load(io.BytesIO(media.npy_tile(pixels.astype(np.uint8))))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_areas_of_a_large_image_take_no_copies():
    """100 MB of samples: the means are those of the definition, and little memory is taken beside them."""
    import tracemalloc

    pixels = np.arange(24 * 3 * 1_400_000, dtype=np.uint32).astype(np.uint8).reshape(-1, 24, 3)
    tracemalloc.start()
    tile, word = media.area_resized(pixels, 16, 16), media.difference_hash(pixels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000 and len(word) == 16
    rows = pixels.reshape(16, -1, 24, 3).mean(1)  # 16 divides the height; columns are cut at halves
    fine = np.repeat(rows, 2, axis=1).reshape(16, 16, 3, 3).mean(2)
    assert np.allclose(tile, fine)


def test_winnowing_query(spark, texts):
    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op9_winnowing"](spark, TINY).collect()}
    assert set(rows) == set(texts)
    by_text = collections.defaultdict(set)
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        k = len(text) // 3
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
        by_text[text].add(rows[i]["fingerprint"])
        assert (rows[i]["near_next"] == 1) >= (text == after)
    assert all(len(x) == 1 for x in by_text.values())


def test_winnowing_query_by_brute_force(spark, texts):
    """Digests and likenesses of the query, from grams hashed, chosen and compared one by one."""

    def printed(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text.lower())]
        grams = []
        for i in range(max(1, len(h) - 2) if h else 0):
            value = 42
            for x in h[i : i + 3]:
                value = xxhash.xxh64_intdigest(struct.pack("<Q", x), value)
            grams.append(value)
        key = [(x >> 33, -i) for i, x in enumerate(grams)]
        picked = sorted({-min(key[i : i + 4])[1] for i in range(max(1, len(key) - 3))}) if key else []
        found = [(grams[i] - (grams[i] >> 63 << 64), i) for i in picked]
        text = "[" + ",".join(f'{{"hash":{x},"pos":{i}}}' for x, i in found) + "]"
        return f"{len(found)}:{hashlib.md5(text.encode()).hexdigest()}", {x for x, _ in found}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in catalog.QUERIES["op9_winnowing"](spark, TINY).collect()}
    for at, i in enumerate(order):
        text, after = texts[i], texts[order[(at + 1) % len(order)]]
        k = len(text) // 3
        own, other, following = printed(text), printed(text[: len(text) - k] + after[:k]), printed(after)
        r = rows[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[0], other[0])
        assert abs(r["near_edited"] - near(own[1], other[1])) < 1e-12 and abs(r["near_next"] - near(own[1], following[1])) < 1e-12


def test_ranges_of_ids_do_not_show(spark, monkeypatch):
    whole = sorted(map(str, catalog.QUERIES["op9_winnowing"](spark, TINY).collect()))
    monkeypatch.setattr(winnowing, "CHUNK_ROWS", 9)
    assert sorted(map(str, catalog.QUERIES["op9_winnowing"](spark, TINY).collect())) == whole


def test_winnowing_by_brute_force(spark):
    rng = np.random.default_rng(6)
    lines = [" ".join(rng.choice(list("abcd"), n)) for n in (1, 2, 3, 5, 6, 7, 30, 80)] + ["a " * 20]
    grams = {tuple(w[i : i + 3]) for t in lines for w in [t.split()] for i in range(max(1, len(w) - 2))}
    rows = spark.createDataFrame([(" ".join(g), list(g)) for g in grams], "g string, w array<string>")
    hashed = rows.select("g", F.xxhash64(*[F.when(F.get("w", F.lit(i)).isNotNull(), F.xxhash64(F.get("w", F.lit(i)))) for i in range(3)]).alias("h"))
    value = {r["g"]: r["h"] for r in hashed.collect()}
    found = spark.createDataFrame([(t,) for t in lines], "t string").select("t", winnowing.fingerprint(F.col("t")).alias("f")).collect()
    for r in found:
        w = r["t"].split()
        h = [value[" ".join(w[i : i + 3])] for i in range(max(1, len(w) - 2))]
        key = [((x % 2**64) >> 33, -i) for i, x in enumerate(h)]
        picked = {-min(key[i : i + 4])[1] for i in range(max(1, len(h) - 3))}
        assert [(x["hash"], x["pos"]) for x in r["f"]] == [(h[i], i) for i in sorted(picked)]


def test_lm_base_by_brute_force(spark, texts):
    rows = catalog.QUERIES["op2_lm"](spark, TINY).collect()
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    same = collections.defaultdict(set)
    for r in rows:
        same[texts[r["doc_id"]]].add(round(r["score"], 6))
    assert all(len(x) == 1 for x in same.values())


def test_lm_texts_are_a_distribution(spark, tmp_path):
    """The probabilities of all texts of up to six words from a vocabulary of three add up to at most one, and to most of it."""
    from lorescope.llm import lm

    words = ["aa", "bb", "cc"]
    learned = [(i, " ".join(words[(i * k) % 3] for k in range(i % 5 + 1))) for i in range(1, 60)]
    texts = [" ".join(x) for n in range(7) for x in itertools.product(words, repeat=n)]
    asked = [(1000 + k, x) for k, x in enumerate(texts)]
    spark.createDataFrame(learned + asked, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    rows = lm.score(spark.read.parquet(str(tmp_path / "d")), F.col("doc_id") < 1000).filter("doc_id >= 1000").collect()
    assert len(rows) == 1093 and 0.5 < sum(10 ** r["score"] for r in rows) <= 1 + 1e-9


def test_lm_learns(spark):
    rows = catalog.QUERIES["op2_lm"](spark, SMALL).collect()
    held = [r for r in rows if r["held_out"]]
    known = [r for r in held if r["n_known"] >= 0.95 * r["n_tokens"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)


def test_lm_hears_word_order(spark, tmp_path):
    """Texts in the order of the training texts cost fewer bits than the same words shuffled; no word repeats in a text."""
    from lorescope.llm import lm

    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]

    def fluent():
        at = np.cumsum(draw.choice([1, 2, 4], 14)) + draw.integers(60)
        return [words[i % 60] for i in at]

    learned = [(i, " ".join(fluent())) for i in range(1, 1000)]
    asked = [fluent() for _ in range(50)]
    rows = learned + [(1000 + k, " ".join(x)) for k, x in enumerate(asked)] + [(2000 + k, " ".join(draw.permutation(x))) for k, x in enumerate(asked)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    score = {r["doc_id"]: r["score"] for r in lm.score(spark.read.parquet(str(tmp_path / "d")), F.col("doc_id") < 1000).collect()}
    lead = [score[1000 + k] - score[2000 + k] for k in range(50)]
    assert sum(x > 0 for x in lead) >= 49 and sum(lead) / 50 > 2.0  # log10 of the probability


def test_neardup_cells_are_bounded_in_members(spark):
    """5001 short members of one centre are compared in three slices, and no matrix has a side for all of them."""
    stars = spark.range(1, 5001).selectExpr("id AS a", "0L AS b")
    reps = spark.range(5001).selectExpr("id AS rep", "7L AS n_shingles")
    groups = neardup._groups(stars, spark.createDataFrame([], "id bigint, comp bigint"), reps)
    assert [r["slices"] for r in groups.select("slices").distinct().collect()] == [3]
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 4000, 9).astype(np.uint64)) for _ in range(2500)]
    found = {}
    for i, j, shared in neardup._shared(sets):
        assert max(shared.shape) <= 1024
        found.update({(i + x, j + y): shared[x, y] for x, y in zip(*np.nonzero(shared)) if i + x > j + y})
    holders, truth = collections.defaultdict(list), collections.Counter()
    for k, own in enumerate(sets):
        for g in own.tolist():
            truth.update((k, other) for other in holders[g])
            holders[g].append(k)
    assert found == dict(truth)


def test_an_oracle_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    assert compare(catalog.QUERIES[name](spark, TINY), catalog.ORACLES[name], TINY) == ""
