"""Merkle manifest: every column by brute force, places by bitmaps, odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import odd  # noqa: F401  (a fixture)

from lorescope.llm import catalog, manifest

TINY = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proved(leaves):
    """The last node and, per leaf, its siblings by level as (before, after)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            path.append(("".join(level[i - i % 8 : i]), "".join(level[i + 1 : i - i % 8 + 8])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    """Sorted (key, leaf, subroot, root, path) of (key, grp, leaf)."""
    groups = collections.defaultdict(list)
    for key, grp, leaf in rows:
        groups[grp].append((key is not None, key or 0, leaf, key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: (sorted(groups[g]), *proved([x[2] for x in sorted(groups[g])])) for g in order}
    root, above = proved([made[g][1] for g in order])
    return sorted((repr(x[3]), x[2], made[g][1], root, p + up) for g, up in zip(order, above) for x, p in zip(made[g][0], made[g][2]))


def found(rows):
    return sorted((repr(r["key"]), r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in rows.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "key bigint, grp string, leaf string").repartition(4)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [1] * 9, [64, 65, 3], [513, 5], [4097, 600, 1]])
def test_trees_by_brute_force(spark, sizes):
    rng = np.random.default_rng(len(sizes))
    rows = [(int(k), f"g{g}", sha(f"{g} {k}")) for g, n in enumerate(sizes) for k in rng.choice(5 * n, n, replace=False)]
    assert found(manifest.manifest(frame(spark, rows))) == brute(rows)


def test_ids_of_any_size_and_several_rows(spark):
    keys = [-(2**63), -(2**40) - 3, -1, 0, 1, 7, 32767, 32768, 2**31, 2**47 + 5, 2**63 - 1]
    rows = [(k, g, sha(f"{k} {g}")) for k in keys for g in (None, "é", "z", "")]
    rows += [(7, "z", sha(f"more {i}")) for i in range(40)] + [(7, "z", sha("same"))] * 5 + [(None, "z", sha(f"{i}")) for i in range(20)] + [(None, None, sha("x"))] * 2
    assert found(manifest.manifest(frame(spark, rows))) == brute(rows)


def test_many_groups(spark):
    rows = [(i, f"group {i % 700}", sha(str(i))) for i in range(1500)]
    assert found(manifest.manifest(frame(spark, rows))) == brute(rows)


def test_ranks_in_lists_and_bits(spark):
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.choice(1 << 15, 5000, replace=False), (3 << 15) + rng.choice(1 << 15, 100, replace=False)])
    rows = cut = spark.createDataFrame([(int(k), "a", "x") for k in keys], "key bigint, grp string, leaf string")
    known, _ = manifest.placed(rows)
    assert {r["key"]: r["idx"] for r in known.collect()} == {int(k): i for i, k in enumerate(sorted(keys))}
    maps = {r["hi"]: r for r in manifest.containers(cut.select(F.lit(0).cast("bigint").alias("g"), "key")).collect()}
    assert maps[0]["low"] is None and len(maps[0]["bits"]) == 4096 and len(maps[3]["low"]) == 100 and maps[3]["bits"] is None and maps[3]["base"] == 5000


def test_odd_rows(odd):  # noqa: F811
    values = [F.col(c) for c in ("doc_id", "lang", "text")]
    rows = odd.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), manifest.leaf_hash(values).alias("leaf"))
    plain = [tuple(r) for r in rows.collect()]
    assert found(manifest.manifest(rows)) == brute(plain)
    assert leaf_of(None, None, "") in {leaf_of(*r) for r in odd.select("doc_id", "lang", "text").collect()} or len(plain) == 17
    assert {r["leaf"] for r in rows.collect()} == {leaf_of(*r) for r in odd.select("doc_id", "lang", "text").collect()}
    empty = manifest.manifest(rows.limit(0))
    assert empty.count() == 0 and empty.columns == ["key", "leaf", "subroot", "root", "path"]


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").collect()
    rows = [(d["doc_id"], d["lang"], leaf_of(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"])) for d in docs]
    proofs = {int(k): (leaf, sub, root, path) for k, leaf, sub, root, path in brute(rows)}
    got = catalog.QUERIES["op12_manifest"](spark, TINY).collect()
    assert len(got) == len(docs) and {r["verified"] for r in got} == {True, False}
    texts = {d["doc_id"]: d for d in docs}
    for r in got:
        leaf, sub, root, path = proofs[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, sub, root)
        assert r["proof_sha256"] == sha("".join(a + b for a, b in path))
        d = texts[r["doc_id"]]
        text = d["text"]
        if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        node = leaf_of(d["doc_id"], d["source"], d["lang"], d["n_chars"], text)
        for before, after in path:
            node = sha(before + node + after)
        assert r["folded_root"] == node and r["verified"] == (node == root)
