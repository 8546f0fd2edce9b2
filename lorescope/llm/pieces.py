"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; its normaliser, the metaspace marker, BPE merges or unigram scores and
byte fallback are rebuilt as a ``tokenizers.Tokenizer``, which normalises, encodes and decodes. Where no piece has
the marker inside, a text is the concatenation of its marker-led segments, so each task encodes and decodes a segment
once, in batches over several threads, and looks it up afterwards; other models get whole texts. Sentencepiece
verifies every segment: where it differs its ids replace the backend's, and the text's ``parity`` is false. As no merge
and no byte run crosses a marker, segments that agree are texts that agree, and segments that decode to themselves are
texts that do.

Cases: a NULL or empty text has no ids and decodes to an empty text; texts of blanks, repeated rows and very long
texts are encoded whole; a text with the marker itself decodes to one with blanks, so it makes no round trip; NULL ids
decode to NULL; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lorescope.llm.common import frugal, narrowed, texts_of
from lorescope.llm.registry import documents, query

MODEL = os.environ.get("LORESCOPE_SP_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
THREADS = 2  # of a task, for encoding batches
KNOWN = 150_000  # segments a task remembers before it starts anew
JOINED = 64  # segments encoded as one line
KNOWN_CHARS = 16 << 20  # and how long they may be in all

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SEGMENT = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]  # text, score, type
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # removes extra white space

    @staticmethod
    def parse(data: bytes) -> Spec:
        pieces, trainer, normal = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if trainer.get(24, 0) or not normal.get(5, 1):
            raise ValueError("models with the marker behind words or without it are not supported")
        if any(t == USER for _, _, t in pieces):
            raise ValueError("models with user-defined pieces are not supported")
        return Spec(pieces, kind == 1, bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)))

    def separable(self) -> bool:
        """No piece has the marker inside, so a text falls apart before every run of markers."""
        return all(MARK not in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)

    def normalizer(self):
        from tokenizers import Regex, normalizers as N

        steps = [N.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [N.Replace(Regex(" {2,}"), " "), N.Replace(Regex("^ +| +$"), "")]
        if self.dummy_prefix:
            steps.append(N.Prepend(MARK))
        return N.Sequence([*steps, N.Replace(" ", MARK)])

    def tokenizer(self):
        """The whole pipeline: normaliser, model and decoder."""
        from tokenizers import Tokenizer, decoders as D, models

        unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if self.unigram:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk, self.byte_fallback)
        else:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            usable = {p for p, _, t in self.pieces if t == NORMAL}
            merges = []
            for p, score, t in self.pieces:
                if t == NORMAL:
                    cuts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
                    merges += [(-score, ids[p], ids[a], ids[b], (a, b)) for a, b in cuts]
            merges.sort(key=lambda m: m[:4])
            model = models.BPE(ids, [m[-1] for m in merges], unk_token=self.pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        out.normalizer = self.normalizer()
        unknown = [D.Replace(self.pieces[unk][0], " ⁇ ")] if unk is not None and not self.byte_fallback else []
        out.decoder = D.Sequence([*unknown, D.Replace(MARK, " "), D.ByteFallback(), D.Fuse(), *([D.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out


class Codec:
    """A model in a task: encodes and decodes texts by segments."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.spec = Spec.parse(data)
        self.threads = threads
        self.by_segment = self.spec.separable() and self.spec.dummy_prefix and not self.spec.squeeze and not self.spec.charsmap
        self.backend = self.spec.tokenizer()
        self.truth = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.leads = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])
        quiet = (CONTROL, UNUSED, UNKNOWN) if self.spec.byte_fallback else (CONTROL, UNUSED)
        self.silent = np.array([i for i, (_, _, t) in enumerate(self.spec.pieces) if t in quiet])  # no text; never encoded to
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # units that the two libraries encode differently
        self.lossy: set[str] = set()  # units that do not decode to themselves
        self.chars = 0
        if self.by_segment:
            self._keep([""], [self._lone(self._backend_ids)], [self._lone(self.truth.encode)])

    def _backend_ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.backend.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _lone(encode) -> list[int]:
        """Ids of a marker alone, which no text of its own has: what a blank adds behind a letter."""
        letter, both = encode(["a", "a "])
        return both[len(letter) :]

    def _keep(self, units: list[str], own: list[list[int]], want: list[list[int]]) -> None:
        """Remember the ids of units, where they are not sentencepiece's, and whether they decode to the unit."""
        for unit, got, right in zip(units, own, want):
            if got != right:
                self.odd.add(unit)
            self.known[unit] = array("i", right).tobytes()
            self.chars += len(unit)
        back = self.backend.decode_batch(own if self.odd.isdisjoint(units) else want, skip_special_tokens=False)
        self.lossy.update(unit for unit, text in zip(units, back) if text != unit)

    def _learn(self, units: list[str]) -> None:
        """Encode units not seen before with both libraries."""
        if self.by_segment:
            units = self._learn_joined(units)
        if units:
            self._keep(units, self._backend_ids(units), self.truth.encode(units, num_threads=self.threads))

    def _learn_joined(self, units: list[str]) -> list[str]:
        """Encode units without blanks or markers JOINED to a line, which falls apart at the markers of its ids.

        Returns the units still to be learned: others, and those of lines on which the libraries differ or which do not
        decode to themselves.
        """
        plain = [u for u in units if u and " " not in u and MARK not in u]
        left = [u for u in units if not u or " " in u or MARK in u]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        lines = [" ".join(g) for g in groups]
        own = self._backend_ids(lines)
        back = self.backend.decode_batch(own, skip_special_tokens=False)
        for group, line, got, right, text in zip(groups, lines, own, self.truth.encode(lines, num_threads=self.threads), back):
            ids = np.array(got, np.int32)
            begins = np.flatnonzero(self.leads[ids])
            if got != right or text != line or len(begins) != len(group):
                left += group
                continue
            data, at = ids.tobytes(), [*(begins * 4).tolist(), len(ids) * 4]
            self.known.update((unit, data[i:j]) for unit, i, j in zip(group, at[:-1], at[1:]))
            self.chars += len(line)
        return left

    def units(self, text: str) -> list[str]:
        """What a text is encoded by: its segments, each without its first marker and with blanks for the others."""
        if not text or not self.by_segment:
            return [text] if text else []
        if "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        return [s[1:].replace(MARK, " ") for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))]

    def encode_units(self, units: list[list[str]]) -> tuple[list[bytes], list[bool]]:
        """Ids of every list of units as 32-bit numbers, and whether sentencepiece agreed on all of it."""
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self._forget()
        new = list(set(chain.from_iterable(units)).difference(self.known))
        if new:
            self._learn(new)
        get = self.known.__getitem__
        ids = [b"".join(map(get, u)) for u in units]
        return ids, [self.odd.isdisjoint(u) for u in units] if self.odd else [True] * len(units)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of every text as 32-bit numbers, and whether sentencepiece agreed on all of it."""
        return self.encode_units([self.units(t) for t in texts])

    def restored(self, texts: list[str], units: list[list[str]]) -> list[bool]:
        """Whether each text, whose units have just been encoded, decodes to itself."""
        marked = self.by_segment
        return [self.lossy.isdisjoint(u) and not (marked and MARK in t) for t, u in zip(texts, units)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of id lists that lie one after another in ``ids``; ``at`` are their offsets."""
        silent = np.isin(ids, self.silent)
        if silent.any():
            at = at - np.concatenate([[0], np.cumsum(silent)])[at]
            ids = ids[~silent]
        flat, at = ids.tolist(), at.tolist()
        return self.backend.decode_batch([flat[a:b] for a, b in zip(at[:-1], at[1:])], skip_special_tokens=False)


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, threads: int = THREADS) -> DataFrame:
    """doc_id, n_bytes, ids, parity and round_trip (the ids decode to the text) of every row.

    The model file (below a few MB) travels with the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, threads)
        for batch in batches:
            for row, end, raw, at in texts_of(batch.column(1)):
                data, n_bytes, at = raw.tobytes(), np.diff(at), at.tolist()
                texts = [data[a:b].decode() for a, b in zip(at[:-1], at[1:])]
                units = [codec.units(x) for x in texts]
                ids, parity = codec.encode_units(units)
                same = codec.restored(texts, units)
                sizes = _offsets([len(x) // 4 for x in ids])
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row:end], pa.array(n_bytes), pa.ListArray.from_arrays(sizes, pa.array(flat)), pa.array(parity), pa.array(same)],
                    ["doc_id", "n_bytes", "ids", "parity", "round_trip"],
                )

    return narrowed(docs, ["doc_id", "text"]).mapInArrow(frugal(run), "doc_id bigint, n_bytes bigint, ids array<int>, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``encoded``, all columns, with the text of ``ids`` as decoded."""
    at_ids = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, 1)
        for batch in batches:
            column = batch.column(at_ids)
            sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            decoded: list[str | None] = []
            step = 0
            while step < len(sizes):  # a million ids or one row at a time
                stop = max(step + 1, step + int(np.searchsorted(np.cumsum(sizes[step:]), 1 << 20, "right")))
                part = column[step:stop]
                decoded += codec.decode(part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[step:stop])]))
                step = stop
            valid = column.is_valid().to_pylist()
            texts = pa.array([x if v else None for x, v in zip(decoded, valid)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(frugal(run), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


@query("op4_sentencepiece")
def op4(spark, folder):
    coded = encode(documents(spark, folder), model_bytes())
    return coded.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")
