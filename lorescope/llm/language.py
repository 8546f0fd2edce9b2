"""Language identification by cross-parsing entropy.

A suffix automaton per language holds a bounded sample of labelled text. Every text is cut into the longest
phrases that occur in that sample; phrases times log2(sample bytes) per byte of text estimate the bits a byte
costs under the language, and the language with the fewest wins. Parsing runs over all languages and many
stretches of text at once, one table lookup a byte.

Sample bound: SAMPLE_BYTES bytes per language, and ALL_BYTES over all of them where there are many (each gets the same),
from distinct texts with a letter drawn by a hash of the text: SAMPLE_DOCS documents, those of LITTLE to SHORT bytes
first, which fill it, then longer ones; where both are few, up to LITTLE_DOCS smaller ones. The table has two states a
sampled byte at most. Everything else covers all rows. A stretch of STRETCH bytes ends a phrase for every language.

Cases: a NULL text, an empty one or one without a letter is ``und`` with score 0; rows with a NULL language or
text are never learned from; equal scores go to the first language by code point; without any labelled row all
is ``und``; repeated rows are predicted each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lorescope.llm.common import crc_mod, filtered, frugal, narrowed, texts_of
from lorescope.llm.registry import documents, query

SAMPLE_DOCS = 64
SAMPLE_BYTES = 16384
ALL_BYTES = 16 * SAMPLE_BYTES
SHORT = 4096
LITTLE = SAMPLE_BYTES // SAMPLE_DOCS
LITTLE_DOCS = 1024
STRETCH = 256
SHARPNESS = 12.0  # how fast the score nears 1 with the lead in bits per byte
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


_AS_SPACE = np.arange(256, dtype=np.uint8)
_AS_SPACE[[x for x in range(128) if not chr(x).isalpha()]] = 32


def spelled(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with every run of ASCII bytes that are no letters as one space."""
    raw = _AS_SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return raw[keep], total[at]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] != longest[p] + 1:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return moves


@dataclass
class Model:
    """Automata as one table: the entry at state + symbol is the next state's offset, 0 if there is none."""

    languages: list[str]
    symbol: np.ndarray  # of each byte value; 0 for bytes no sample has
    table: np.ndarray
    start: np.ndarray  # offset after a symbol from the root of each language, the root itself if none
    roots: np.ndarray
    bits: np.ndarray  # log2 of each sample's size

    @staticmethod
    def of(samples: dict[str, bytes]) -> Model:
        languages = sorted(samples, key=lambda x: x.encode())
        seen = sorted(set(b"".join(samples.values())))
        symbol = np.zeros(256, np.int32)
        symbol[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        blocks, roots, size = [np.zeros(width, np.int32)], [], width
        for name in languages:
            moves = automaton(samples[name])
            block = np.zeros((len(moves), width), np.int32)
            for state, out in enumerate(moves):
                for c, to in out.items():
                    block[state, symbol[c]] = size + to * width
            roots.append(size)
            size += block.size
            blocks.append(block.ravel())
        table = np.concatenate(blocks)
        roots = np.array(roots, np.int32)
        start = table[roots[:, None] + np.arange(width)[None, :]] if len(roots) else np.zeros((0, width), np.int32)
        start = np.where(start == 0, roots[:, None], start).astype(np.int32)
        return Model(languages, symbol, table, start, roots, np.log2([max(2, len(samples[x])) for x in languages]))

    def shared(self, df: DataFrame):
        """The fields as a broadcast: SAMPLE_BYTES bounds the table of a language to 2 * SAMPLE_BYTES states."""
        return df.sparkSession.sparkContext.broadcast(
            (self.languages, self.symbol, self.table, self.start, self.roots, self.bits)
        )

    def phrases(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of every text in the buffer under every language (texts x languages)."""
        sizes = np.diff(at)
        cuts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = at[:-1][owner] + nth * STRETCH
        length = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        symbols = self.symbol[raw]
        n = len(self.languages)
        counts = np.zeros((n, len(owner)), np.int32)
        state = np.repeat(self.roots[:, None], len(owner), 1)
        row = np.arange(n)[:, None]
        active = np.searchsorted(-length, -np.arange(STRETCH), "left")  # stretches longer than t
        for t in range(int(length[0]) if len(length) else 0):
            k = active[t]
            c = symbols[begin[:k] + t]
            step = self.table[state[:, :k] + c]
            ended = step == 0
            counts[:, :k] += ended
            state[:, :k] = np.where(ended, self.start[row, c], step)
        counts += state != self.roots[:, None]
        out = np.zeros((len(sizes), n))
        for i in range(n):
            out[:, i] = np.bincount(owner, counts[i], len(sizes))
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        labels, scores = [], np.zeros(len(column))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lower = pc.utf8_lower(column.fill_null("") if column.null_count else column)
        for row, end, raw, at in texts_of(lower):
            raw, at = spelled(raw, at)
            cost = self.phrases(raw, at) * self.bits / np.maximum(np.diff(at), 1)[:, None]
            for k in range(end - row):
                if not self.languages or _LETTER.search(lower[row + k].as_py()) is None:
                    labels.append(UNKNOWN)
                    continue
                best = int(np.argmin(cost[k]))
                labels.append(self.languages[best])
                scores[row + k] = 1 / np.exp(-SHARPNESS * (cost[k] - cost[k, best])).sum()
        return labels, scores


def fit(docs: DataFrame, learn: Column | None = None) -> Model:
    """A model of the ``lang`` column from a bounded sample of the rows for which ``learn`` holds."""
    rows = docs if learn is None else docs.filter(learn)
    rows = narrowed(rows, ["text", "lang"]).filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    tier = F.when(size < LITTLE, 2).when(size > SHORT, 1).otherwise(0)
    rows = rows.withColumns({"_tier": tier, "_draw": F.xxhash64("text")})
    drawn = rows.select("lang", "_tier", "_draw").distinct()  # copies count once
    nth = F.row_number().over(W.partitionBy("lang").orderBy("_tier", "_draw"))
    picked = drawn.withColumn("_nth", nth).filter(F.col("_nth") <= LITTLE_DOCS)
    picked = picked.filter((F.col("_nth") <= SAMPLE_DOCS) | (F.col("_tier") == 2))
    chosen = rows.join(F.broadcast(picked), ["lang", "_tier", "_draw"]).select("lang", "_nth", F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    samples: dict[str, bytes] = {}
    for r in chosen.dropDuplicates(["lang", "_nth"]).orderBy("lang", "_nth").toLocalIterator():
        have = samples.get(r["lang"], b"")
        if len(have) < SAMPLE_BYTES:
            text = np.frombuffer(pc.utf8_lower(pa.scalar(r["text"])).as_py().encode() + b" ", np.uint8)
            text, _ = spelled(text, np.array([0, len(text)]))
            samples[r["lang"]] = (have + text.tobytes())[:SAMPLE_BYTES]
    room = ALL_BYTES // max(len(samples), ALL_BYTES // SAMPLE_BYTES)
    return Model.of({name: text[:room] for name, text in samples.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row."""
    shared = model.shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            labels, scores = own.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float, few: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, in a learned language with at least that score.

    Texts of fewer than ``few`` code points stay whenever they have a letter: so little text may fit several languages
    as well, which says nothing against it.
    """
    shared = model.shared(docs)

    def make():
        own = Model(*shared.value)

        def test(texts: pa.Array) -> np.ndarray:
            labels, scores = own.predict(texts)
            short = pc.less(pc.utf8_length(texts), few).fill_null(False)
            return np.array([x != UNKNOWN for x in labels], bool) & ((scores >= least) | np.asarray(short, bool))

        return test

    return filtered(docs, "text", make)


def held_out() -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return crc_mod("doc_id", 4) == 2


@query("op6_language")
def op6(spark, folder):
    docs = documents(spark, folder)
    return predict(docs, fit(docs, learn=~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
