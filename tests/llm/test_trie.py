"""Prefix trie of conversations: all nodes by brute force, with containers that burst and ones that do not, odd rows."""

import collections
import hashlib
import random
import zlib

import pytest
from harness import compare
from pyspark.sql import functions as F

from lorescope.llm import catalog, trie

TINY = "/root/testdata/sf0.001"
NAMES = [c.split()[0] for c in trie._NODE.split(", ")]


def ordered(rows):
    """Turns (role, text) by conversation, of rows (conv_id, turn, role, text)."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        convs[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}


def as_rebuilt(convs):
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 9
        made[c] = ([] if c is None else convs.get(c - c % 5, []))[:h] + own[h:]
    return made


def brute(convs):
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    least = {p: min((c for c in members if c is not None), default=None) for p, members in nodes.items()}
    out = []
    for p, members in nodes.items():
        kids = sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        under = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in under)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if c is not None and tuple(convs[c]) == p))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)


def some(n, seed, kinds=3, most=7):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), f"é{draw.randrange(kinds)}") for c in range(n) for t in range(draw.randrange(1, most))]


LIMITS = {"whole": {}, "small": {"MOST_SEQUENCES": 4, "MOST_LISTED": 2, "PIECE": 5, "STRIDE": 2}, "turns": {"MOST_SEQUENCES": 1, "MOST_TURNS": 3, "STRIDE": 1}}


@pytest.mark.parametrize("limits", LIMITS)
def test_nodes_by_brute_force(spark, monkeypatch, limits):
    for name, value in LIMITS[limits].items():
        monkeypatch.setattr(trie, name, value)
    rows = some(60, 1)
    rows += [(100 + c, t, "user", f"shared {t}") for c in range(20) for t in range(9 + c % 3)]  # long stretches, many copies
    rows += [(200, t, "user", f"alone {t % 5}") for t in range(30)]
    turns = trie.turns_of(frame(spark, rows))
    assert found(trie.trie(*trie.whole(turns))) == brute(ordered(rows))
    if limits == "small":
        assert found(trie.trie(*trie.rebuilt(turns))) == brute(as_rebuilt(ordered(rows)))


def test_odd_rows(spark):
    rows = [(5, 2, "user", "b"), (5, None, None, None), (5, 1, "user", None), (5, 1, None, "user"), (5, 1, "user", None), (6, 1, "", ""), (None, 1, "user", "x"), (None, 0, "user", "y"),
            (7, 1, "user", "z" * 100_000), (-3, 1, "user", "x"), (10, 0, "u", "q"), (11, 0, "u", "w"), (12, None, "u", "w")]
    clash = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("key", "pos", "tid", "n_bytes", "seq", "box", "depth", "a.b", "TOP")})
    turns = trie.turns_of(clash)
    assert found(trie.trie(*trie.whole(turns))) == brute(ordered(rows))
    named = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(trie.trie(*trie.rebuilt(trie.turns_of(frame(spark, named))))) == brute(as_rebuilt(ordered(named)))
    assert trie.trie(*trie.rebuilt(trie.turns_of(clash.limit(0)))).count() == 0


def test_query(spark):
    rows = catalog.QUERIES["op13_trie"](spark, TINY)
    assert compare(rows, catalog.ORACLES["op13_trie"], TINY) == ""
    given = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(rows.select(*NAMES)) == brute(as_rebuilt(ordered(given)))
