"""LM scoring by online logistic context mixing.

A token costs the bits of a few binary decisions. Does it repeat a word of its document? If not, is it a word of the
training texts? A known word costs its share of the training tokens whose words are not in the document yet, a
repeated one its share of the document so far, an unknown one is spelled, byte by byte and bit by bit. Every decision is predicted by several tables indexed by
hashed contexts; their predictions are combined in the logistic domain by weights that a gate selects, learned online
in the order of the training data, and refined by an adaptive map of what followed such predictions. Tasks learn on
what they hold; counts and maps are added up, weights averaged by the bits behind them.

Known words cost by kind of document: a few bits of a hash of its words name a text's kind in training, and a text is
scored by the kinds mixed as they predicted it so far.

Word order counts by a second prediction of every known word, repeated or not: CODE_BITS bits of its hash, each
predicted from the text's kind, the word before and the two before, mixed, gated and refined as above, and then the
word's share of the training tokens with these bits. Both predictions are averaged by weights that follow how well each
did in the text so far. The tables of the last two contexts grow with the corpus up to 2**MOST_CODE_SLOTS slots each.

Counts of words are exact and grow with the corpus: a block of documents sends each of its words once to the word's
bucket, where counts are added and sent back to the blocks that have the word. Words meet by 64-bit hashes. The other
tables of contexts have a fixed size. A block is what one task reads, so ``docs`` has to be a stored table, whose tasks
are the same each time; a word that a block did not announce raises an error.

Cases: a NULL text is empty and has only the end token; repeated rows are scored, and learned from, each; without
training rows all words are spelled; ties do not arise, as equal texts get equal scores in any order; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.llm.common import batch_rows, crc_mod, frugal, lowered, mixed, narrowed, span_hashes, texts_of, word_spans
from lorescope.llm.registry import documents, query
from lorescope.session import cut_lineage

BUCKET_WORDS = 500_000  # words of blocks that meet in one bucket, about
END = np.uint64(0x5BD1E995A1B2C3D5)  # stands for the end token among word hashes

# Slots of the context tables for spelling: by place, by the last byte, the last two, three and four.
SPELL_SLOTS = (1 << 16, 1 << 16, 1 << 17, 1 << 17, 1 << 17)
# Slots of those for repeats: by place, by what happened last and how often, by the last word, by the last two.
REPEAT_SLOTS = (16, 256, 4096, 4096)
RATE = 0.4
KINDS = 8  # of documents, by the signs of KIND_BITS sums over word hashes
KIND_BITS = 3
BLEND = 0.05  # of the whole corpus in the word shares of a kind
STEPS = 33  # of an adaptive map
PRIOR = 20.0  # tokens' worth of belief in the usual share of unknown words
FAN = 16  # states of tasks that one task adds up
CELLS = 1 << 17  # bytes spelled at a time
CODE_BITS = 8  # of a word's hash that are predicted in context
MOST_CODE_SLOTS = 21  # log2 of the slots by the last word, and of those by the last two
PIECE = 1 << 17  # numbers of the code tables that travel in one row
TRUST = 0.3  # in the words predicted in context, at the start of a text
TRUST_TOKENS = 8.0  # how many tokens that belief is worth
FIXED = 30  # bits after the point of sums over the tokens of a text
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _starts(slots: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(slots)]).astype(np.int64)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


class Mixer:
    """Weights per gate over the stretched predictions of several tables, and an adaptive map of the result."""

    def __init__(self, inputs: int, gates: int, state: np.ndarray | None = None):
        self.inputs, self.gates = inputs, gates
        self.weights = np.full((gates, inputs), 1.0 / inputs)
        self.seen = np.zeros(gates)
        self.map = np.zeros((2, gates, STEPS))
        if state is not None:
            n = gates * inputs
            self.seen = state[n : n + gates]
            some = self.seen > 0
            self.weights[some] = (state[:n].reshape(gates, inputs))[some] / self.seen[some, None]
            self.map = state[n + gates :].reshape(2, gates, STEPS)

    def state(self) -> np.ndarray:
        """What adds up over tasks."""
        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.map.ravel()])

    @staticmethod
    def width(inputs: int, gates: int) -> int:
        return gates * inputs + gates + 2 * gates * STEPS

    def _dot(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(gate))
        for j, x in enumerate(inputs):
            dot += np.ascontiguousarray(self.weights[:, j])[gate] * x
        return np.clip(dot, -12, 12, out=dot)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bits: np.ndarray) -> None:
        dot = self._dot(inputs, gate)
        error = bits - 1 / (1 + np.exp(-dot))
        n = np.bincount(gate, minlength=self.gates)
        rate = RATE / np.maximum(n, 1)
        for j, x in enumerate(inputs):
            self.weights[:, j] += rate * np.bincount(gate, error * x, self.gates)
        self.seen += n
        cell = gate * STEPS + np.rint((dot + 12) * (STEPS - 1) / 24).astype(np.int64)
        size = self.gates * STEPS
        self.map[0] += np.bincount(cell, minlength=size).reshape(self.gates, STEPS)
        self.map[1] += np.bincount(cell, bits, size).reshape(self.gates, STEPS)

    def predict(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Probability of a one: half the mixture, half what the map says followed it."""
        dot = self._dot(inputs, gate)
        p = 1 / (1 + np.exp(-dot))
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) * 24 / (STEPS - 1) - 12)))
        curve = (self.map[1] + 8 * centre) / (self.map[0] + 8)
        at = (dot + 12) * (STEPS - 1) / 24
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        cell, curve = gate * STEPS + low, curve.reshape(-1)
        refined = curve[cell] * (1 - part) + curve[cell + 1] * part
        return np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)


# Spelling.


def _cells(words: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The bytes of words, each closed by a blank, a stretch at a time: byte, word and context hashes by order."""
    ends = np.cumsum(lens)
    first = 0
    while first < len(lens):
        base = ends[first] - lens[first]
        last = max(first + 1, int(np.searchsorted(ends + np.arange(1, len(lens) + 1), base + first + CELLS, "right")))
        own = lens[first:last]
        size = own + 1
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        data = np.full(len(place), 32, np.uint64)
        data[place < np.repeat(own, size)] = words[base : ends[last - 1]]
        contexts, past = [np.minimum(place, 15).astype(np.uint64)], np.zeros(len(place), np.uint64)
        for order in range(1, 5):
            before = np.zeros(len(place), np.uint64)
            before[order:] = data[:-order] + np.uint64(1)
            before[place < order] = 0
            past = past * np.uint64(257) + before
            contexts.append(past.copy())
        yield data.astype(np.int64), np.repeat(np.arange(first, last), size), contexts
        first = last


def _bits(data: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Each bit of the bytes, highest first, and its slot in every table."""
    starts = _starts(SPELL_SLOTS)
    node = np.ones(len(data), np.int64)
    for shift in range(7, -1, -1):
        bit = data >> shift & 1
        slots = []
        for j, context in enumerate(contexts):
            h = (context * _A + node.astype(np.uint64)) * _B
            slots.append(starts[j] + (h >> np.uint64(64 - SPELL_SLOTS[j].bit_length() + 1)).astype(np.int64))
        yield bit, slots
        node = node * 2 + bit


def spell_counts(words: np.ndarray, lens: np.ndarray, table: np.ndarray) -> None:
    """Add the zeros and ones seen in every context of the words to ``table`` (2 x slots)."""
    total = int(_starts(SPELL_SLOTS)[-1])
    for data, _, contexts in _cells(words, lens):
        for bit, slots in _bits(data, contexts):
            for slot in slots:
                low = int(slot.min())
                n = np.bincount(2 * (slot - low) + bit)
                n = np.pad(n, (0, len(n) % 2)).reshape(-1, 2)
                table[:, low : low + len(n)] += n.T
    assert table.shape[1] == total


def _spell_inputs(table: np.ndarray, bit: np.ndarray | None, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretched predictions and the gate, the number of orders that have been seen; ``bit`` leaves itself out."""
    inputs, gate = [], np.zeros(len(slots[0]), np.int64)
    for slot in slots:
        n0, n1 = table[0][slot], table[1][slot]
        if bit is not None:
            n0, n1 = n0 - (bit == 0), n1 - (bit == 1)
        inputs.append(_stretch(n0, n1))
        gate += n0 + n1 > 0
    return inputs, gate


def spell_learn(words: np.ndarray, lens: np.ndarray, table: np.ndarray, mixer: Mixer) -> None:
    for data, _, contexts in _cells(words, lens):
        for bit, slots in _bits(data, contexts):
            mixer.learn(*_spell_inputs(table, bit, slots), bit.astype(np.float64))


def spell_cost(words: np.ndarray, lens: np.ndarray, table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 probability of every word, spelled."""
    cost = np.zeros(len(lens))
    for data, word, contexts in _cells(words, lens):
        for bit, slots in _bits(data, contexts):
            p = mixer.predict(*_spell_inputs(table, None, slots))
            cost += np.bincount(word, np.log10(np.where(bit == 1, p, 1 - p)), len(lens))
    return cost


# Known words in context.


def code_slots(size: int) -> int:
    """log2 of the slots that each of the two tables by earlier words has for texts of ``size`` bytes in all."""
    return min(max(size.bit_length() - 7, 12), MOST_CODE_SLOTS)


def _code_bits(code: np.ndarray, kind: np.ndarray, contexts: list[np.ndarray], log_slots: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Each bit of the codes, highest first, and its slot by kind (no two share one) and by every context."""
    mask, base = (1 << log_slots) - 1, KINDS << CODE_BITS
    spread = [(mixed(c * _A + np.uint64(j)) >> np.uint64(8)).astype(np.int64) for j, c in enumerate(contexts)]
    node = np.ones(len(code), np.int64)
    for shift in range(CODE_BITS - 1, -1, -1):
        bit = code >> shift & 1
        slots = [(kind << CODE_BITS) + node]
        for j, context in enumerate(spread):
            slots.append(base + (j << log_slots) + ((context + node * 0x9E3779B1) & mask))
        yield bit, slots
        node = node * 2 + bit


def code_table(log_slots: int) -> np.ndarray:
    """Zeros and ones seen in every slot."""
    return np.zeros(((KINDS << CODE_BITS) + (2 << log_slots), 2), np.float32)


def _levels(seen: np.ndarray) -> np.ndarray:
    """0 to 3: a context never seen, once or twice, up to fifteen times, more often."""
    return (seen > 0).astype(np.int8) + (seen > 2) + (seen > 15)


CODE_INPUTS, CODE_GATES = 3, 16


def code_mixer(state: np.ndarray | None = None) -> Mixer:
    return Mixer(CODE_INPUTS, CODE_GATES, state)


def code_learn(code: np.ndarray, kind: np.ndarray, contexts: list[np.ndarray], log_slots: int, table: np.ndarray, mixer: Mixer) -> None:
    """Learn the weights from what the table holds so far, then add the codes to it."""
    flat, gate, seen = table.reshape(-1), None, []
    pairs = table.view(np.uint64).reshape(-1)  # both counts of a slot are read at once
    for bit, slots in _code_bits(code, kind, contexts, log_slots):
        counts = [pairs[s].view(np.float32).reshape(-1, 2) for s in slots]
        if gate is None:
            gate = sum(_levels(c[:, 0] + c[:, 1]).astype(np.int64) << 2 * j for j, c in enumerate(counts[1:]))
        mixer.learn([_stretch(c[:, 0], c[:, 1]) for c in counts], gate, bit.astype(np.float64))
        seen += [2 * s + bit for s in slots]
    for at in seen:
        np.add.at(flat, at, np.float32(1))


class Codes:
    """Scoring by the summed tables: stretched predictions, how often slots were seen, mass of each code by kind.

    A task makes it from the arrays of ``parts``, which are what a broadcast carries: they load without this package.
    """

    def __init__(self, log_slots: int, state: np.ndarray, stretched: np.ndarray, levels: np.ndarray, mass: np.ndarray):
        self.log_slots, self.state, self.stretched, self.levels, self.mass = log_slots, state, stretched, levels, mass

    @staticmethod
    def parts(table: np.ndarray, log_slots: int, state: np.ndarray) -> tuple:
        half = 1 << CODE_BITS - 1
        leaves = table[: KINDS << CODE_BITS].reshape(KINDS, 2 * half, 2)[:, half:]
        mass = leaves.reshape(KINDS, 2 * half).T.astype(np.float64)  # code x kind
        return log_slots, state, _stretch(table[:, 0], table[:, 1]).astype(np.float32), _levels(table.sum(1)), mass

    def chances(self, code: np.ndarray, kind: np.ndarray, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of every code, and how often its longest context was seen (0 to 3)."""
        mixer, gate, p, level = code_mixer(self.state), None, np.ones(len(code)), None
        for bit, slots in _code_bits(code, kind, contexts, self.log_slots):
            if gate is None:
                levels = [self.levels[s].astype(np.int64) for s in slots[1:]]
                gate, level = sum(x << 2 * j for j, x in enumerate(levels)), levels[-1]
            one = mixer.predict([self.stretched[s] for s in slots], gate)
            p *= np.abs((1 - bit) - one)  # the chance of the bit that came
        return p, level


def averaged(t: Tokens, first: np.ndarray, second: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Both probabilities of every token averaged; the weight is that the second earned in its group of tokens of the text so far."""
    earned = TRUST * second / np.maximum(TRUST * second + (1 - TRUST) * first, 1e-300)
    weight = np.zeros(len(first))
    for g in range(4):
        own = group == g
        told = TRUST_TOKENS * TRUST + t.since_start(np.where(own, earned, 0.0))
        weight = np.where(own, told / (TRUST_TOKENS + t.since_start(own.astype(np.float64))), weight)
    weight = np.clip(weight, 0.0, 1.0)
    return (1 - weight) * first + weight * second


# Tokens of texts.


class Tokens:
    """The tokens of a stretch of texts: hashes with an end token after each text, and where texts begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = lowered(raw)
        starts, ends, owner = word_spans(raw, offsets)
        n = np.bincount(owner, minlength=len(offsets) - 1)
        self.size = n + 1
        self.begin = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(n)), self.size)
        self.place = np.arange(len(self.text)) - self.begin[self.text]
        word = self.place < n[self.text]
        self.hash = np.full(len(self.text), END)
        self.hash[word] = span_hashes(raw, starts, ends)
        self.starts = np.zeros(len(self.text), np.int64)
        self.ends = np.zeros(len(self.text), np.int64)
        self.starts[word], self.ends[word] = starts, ends
        self.raw = raw
        # How often the word came before in its text.
        key = mixed(self.hash + self.text.astype(np.uint64) * _A)
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        index = np.arange(len(key))
        self.before = np.zeros(len(key), np.int64)
        self.before[order] = index - np.maximum.accumulate(np.where(same, 0, index))
        self.repeats = (self.before > 0).astype(np.int64)

    def kinds(self) -> np.ndarray:
        """The kind of each text: words that are frequent in it decide the signs, so texts of one language mostly agree."""
        kind = np.zeros(len(self.size), np.int64)
        for i in range(KIND_BITS):
            sign = 1 - 2 * (self.hash >> np.uint64(40 + i) & np.uint64(1)).astype(np.int64)
            sign[self.hash == END] = 0
            kind = kind * 2 + (np.bincount(self.text, sign, len(self.size)) > 0)
        return kind

    def codes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """CODE_BITS bits of every token's hash, and its contexts: the word before and the two before."""
        last = self.earlier(self.hash, 1)
        return (self.hash >> np.uint64(64 - CODE_BITS)).astype(np.int64), [last, mixed(last + self.earlier(self.hash, 2) * _B)]

    def since_start(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of earlier tokens of the same text.

        In whole units of 2**-FIXED, so that the texts before it in the buffer do not change a text's rounding: the sums
        may pass the range of 64 bits, their differences are exact all the same.
        """
        whole = values.dtype.kind == "i"
        units = values if whole else np.rint(values * 2.0**FIXED).astype(np.int64)
        total = np.cumsum(units) - units
        found = total - np.repeat(total[self.begin], self.size)
        return found if whole else found * 2.0**-FIXED

    def earlier(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[by:] = values[:-by] if by else values
        out[self.place < by] = 0
        return out

    def repeat_contexts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Slot of every token in each table for repeats, and the gate."""
        starts = _starts(REPEAT_SLOTS)
        age = np.minimum(np.log2(self.place + 1).astype(np.int64), 15)
        recent = sum(self.earlier(self.repeats, i + 1) << i for i in range(4))
        often = np.minimum(self.since_start(self.repeats) * 16 // np.maximum(self.place, 1), 15)
        last = self.earlier(self.hash, 1)
        pair = mixed(last + self.earlier(self.hash, 2) * _B)
        slots = [age, recent * 16 + often, (last >> np.uint64(52)).astype(np.int64), (pair >> np.uint64(52)).astype(np.int64)]
        return [s + a for s, a in zip(slots, starts)], np.minimum(age, 7)


def _by_key(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows that agree in their first ``columns`` columns."""
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(columns)]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i


_WORDS, _COUNTS, _REPEATS, _SPELLING, _TOTALS, _CODES, _CODE_WEIGHTS = range(7)
_SCHEMA = "kind int, bucket int, block int, hashes binary, counts binary, lens binary, words binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int32()] * 3 + [pa.binary()] * 4


def _row(kind: int, bucket: int, block: int, *blobs: np.ndarray) -> pa.RecordBatch:
    values = [kind, bucket, block, *[x.tobytes() for x in blobs], *[None] * (4 - len(blobs))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)


def _announced(docs: DataFrame, buckets: int, log_slots: int) -> DataFrame:
    """Rows of each block's words by bucket, with how often training rows of the block have them, of repeats and of codes."""
    width = sum(REPEAT_SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        have = (np.zeros(0, np.uint64), np.zeros((0, KINDS), np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        table, mixer = np.zeros((2, width)), Mixer(len(REPEAT_SLOTS), 8)
        coded, code_weights = code_table(log_slots), code_mixer()
        waiting: list[tuple] = []

        def merged(parts: list[tuple]) -> tuple:
            hashes, counts, lens = (np.concatenate([p[i] for p in parts]) for i in range(3))
            words = np.concatenate([p[3] for p in parts])
            at = np.cumsum(lens) - lens
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            return unique, _by_kind(back, counts, len(unique)), lens[first], _gathered(words, at[first], lens[first])

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for row, end, raw, at in texts_of(batch.column(0)):
                t = Tokens(raw, at)
                learned = train[row:end][t.text]
                unique, first, back = np.unique(t.hash, return_index=True, return_inverse=True)
                lens = (t.ends - t.starts)[first]
                kinds = t.kinds()[t.text]
                counts = np.bincount(back * KINDS + kinds, learned, len(unique) * KINDS).astype(np.int32).reshape(-1, KINDS)
                waiting.append((unique, counts, lens, _gathered(t.raw, t.starts[first], lens)))
                if learned.any():
                    slots, gate = t.repeat_contexts()
                    bits = t.repeats[learned]
                    own = [s[learned] for s in slots]
                    mixer.learn([_stretch(table[0][s], table[1][s]) for s in own], gate[learned], bits.astype(np.float64))
                    for s in own:
                        table[0] += np.bincount(s, 1 - bits, width)
                        table[1] += np.bincount(s, bits, width)
                    code, contexts = t.codes()
                    code_learn(code[learned], kinds[learned], [c[learned] for c in contexts], log_slots, coded, code_weights)
                if len(waiting) > 47:
                    have = merged([have, *waiting])
                    waiting = []
        hashes, counts, lens, words = merged([have, *waiting])
        place = np.cumsum(lens) - lens
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                yield _row(_WORDS, b, block, hashes[own], counts[own], lens[own].astype(np.int32), _gathered(words, place[own], lens[own]))
        yield _row(_REPEATS, -1 - block % 16, block, np.concatenate([table.ravel(), mixer.state()]))
        yield _row(_CODE_WEIGHTS, -1 - block % 16, block, code_weights.state())
        coded = coded.reshape(-1)
        for i in range(0, len(coded), PIECE):
            yield _row(_CODES, -17 - i // PIECE, block, coded[i : i + PIECE])

    return docs.mapInArrow(frugal(run), _SCHEMA)


def _by_kind(back: np.ndarray, counts: np.ndarray, n: int, kind: type = np.int32) -> np.ndarray:
    """Sums of rows of counts that share an entry of ``back``."""
    return np.stack([np.bincount(back, counts[:, k], n) for k in range(KINDS)], 1).astype(kind)


def _gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return data[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


def _merged(rows: DataFrame) -> DataFrame:
    """Per bucket, the counts of all its words for each block that has them, and the training words themselves; per
    task, the counts of spelling contexts, the token totals and the sums of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        spelling = np.zeros((2, sum(SPELL_SLOTS)), np.float32)
        totals = np.zeros(3 + KINDS, np.int64)
        sums, weights, at, held = None, None, None, []
        piece, piece_sum = None, None

        def bucket() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate([h[1] for h in held])
            unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            kinds = _by_kind(back, np.concatenate([h[2] for h in held]).reshape(-1, KINDS), len(unique), np.int64)
            counts = kinds.sum(1)
            lens, words = np.concatenate([h[3] for h in held]).astype(np.int64), np.concatenate([h[4] for h in held])
            place = np.cumsum(lens) - lens
            known = first[(counts > 0) & (lens[first] > 0)]
            own, sizes = _gathered(words, place[known], lens[known]), lens[known]
            spell_counts(own, sizes, spelling)
            totals[:] += [counts.sum(), (counts > 0).sum(), (counts == 1).sum(), *kinds.sum(0)]
            yield _row(_WORDS, at, -1, np.zeros(0), np.zeros(0), sizes.astype(np.int32), own)
            begin = 0
            for block, h, *_ in held:
                own = back[begin : begin + len(h)]
                yield _row(_COUNTS, at, block, h, counts[own], kinds[own].astype(np.float32))
                begin += len(h)

        for batch in batches:
            for i in range(batch.num_rows):
                kind, b, block = (batch.column(c)[i].as_py() for c in range(3))
                blobs = [batch.column(c)[i].as_buffer() for c in range(3, 7) if batch.column(c)[i].is_valid]
                if kind == _CODES:
                    own = np.frombuffer(blobs[0], np.float32)
                    if b != piece:
                        if piece_sum is not None:
                            yield _row(_CODES, piece, -1, piece_sum)
                        piece, piece_sum = b, own.copy()
                    else:
                        piece_sum += own
                    continue
                if kind == _CODE_WEIGHTS:
                    own = np.frombuffer(blobs[0])
                    weights = own.copy() if weights is None else weights + own
                    continue
                if kind == _REPEATS:
                    own = np.frombuffer(blobs[0])
                    sums = own.copy() if sums is None else sums + own
                    continue
                if b != at:
                    if held:
                        yield from bucket()
                    at, held = b, []
                held.append((block, *[np.frombuffer(x, t).copy() for x, t in zip(blobs, (np.uint64, np.int32, np.int32, np.uint8))]))
        if held:
            yield from bucket()
        if piece_sum is not None:
            yield _row(_CODES, piece, -1, piece_sum)
        if sums is not None:
            yield _row(_REPEATS, -1, task, sums)
        if weights is not None:
            yield _row(_CODE_WEIGHTS, -1, task, weights)
        if totals[0]:
            yield _row(_SPELLING, -1, task, spelling.astype(np.float64))
        yield _row(_TOTALS, -1, task, totals)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(run), _SCHEMA)


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the vectors in ``hashes``, FAN of them a task at a time; one vector of fixed size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["hashes"])

    few = rows.select("hashes")
    parts = few.count()
    while True:
        parts = max(1, -(-parts // FAN))
        few = few.repartition(parts).mapInArrow(frugal(run), "hashes binary")
        if parts == 1:
            return np.frombuffer(few.first()["hashes"]).copy()


BATCH = 100  # rows, with whole texts or with words by bucket, that Python tasks get at a time


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """The scores of all rows as a stored table; see ``_scored``."""
    with batch_rows(docs.sparkSession, BATCH):
        return cut_lineage(_scored(docs, learn))


def _scored(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, learned (whether ``learn`` holds), n_bytes, n_tokens, n_known, train_tokens, base_score, score (log10 of
    the text's probability) and bits_per_byte of every row, from the rows for which ``learn`` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, size // (8 * BUCKET_WORDS))
    log_slots = code_slots(size)
    table = cut_lineage(_merged(_announced(rows.select("text", "learned"), buckets, log_slots)))

    seen = [int(v or 0) for v in _totals(table)]
    totals, by_kind = dict(zip(("n", "v", "once"), seen)), np.maximum(np.array(seen[3:], np.float64), 1)
    width = sum(REPEAT_SLOTS)
    repeats = _summed(table.filter(F.col("kind") == _REPEATS), 2 * width + Mixer.width(len(REPEAT_SLOTS), 8))
    slots = sum(SPELL_SLOTS)
    spelling = _summed(table.filter(F.col("kind") == _SPELLING), 2 * slots).reshape(2, slots).astype(np.float32)
    gates = len(SPELL_SLOTS) + 1
    coded = code_table(log_slots)
    for r in table.filter(F.col("kind") == _CODES).select("bucket", "hashes").toLocalIterator():
        own, begin = np.frombuffer(r["hashes"], np.float32), (-17 - r["bucket"]) * PIECE
        coded.reshape(-1)[begin : begin + len(own)] += own
    code_state = _summed(table.filter(F.col("kind") == _CODE_WEIGHTS), Mixer.width(CODE_INPUTS, CODE_GATES))
    shared_codes = spark.sparkContext.broadcast(Codes.parts(coded, log_slots, code_state))  # bounded by MOST_CODE_SLOTS
    shared_table = spark.sparkContext.broadcast(spelling)  # of fixed size

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(len(SPELL_SLOTS), gates)
        for batch in batches:
            for lens, words in zip(batch.column(0), batch.column(1)):
                spell_learn(np.frombuffer(words.as_buffer(), np.uint8), np.frombuffer(lens.as_buffer(), np.int32).astype(np.int64), shared_table.value, mixer)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([mixer.state().tobytes()], pa.binary())], ["block", "hashes"])

    vocabulary = table.filter((F.col("kind") == _WORDS) & (F.octet_length("lens") > 0)).select("lens", "words")
    weights = _summed(cut_lineage(vocabulary.mapInArrow(frugal(weigh), "block bigint, hashes binary")), Mixer.width(len(SPELL_SLOTS), gates))

    counted = table.filter(F.col("kind") == _COUNTS).select("block", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("learned"), F.lit(None).cast("string").alias("text"), "hashes", "counts", F.col("lens").alias("kinds"))
    texts = rows.select(F.spark_partition_id().alias("block"), "doc_id", "learned", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("kinds"))
    both = counted.unionByName(texts).withColumn("order", F.col("hashes").isNull()).select("block", "order", "doc_id", "learned", "text", "hashes", "counts", "kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell_mixer = Mixer(len(SPELL_SLOTS), gates, weights)
        repeat_table, repeat_mixer = repeats[: 2 * width].reshape(2, width), Mixer(len(REPEAT_SLOTS), 8, repeats[2 * width :])
        codes = Codes(*shared_codes.value)
        code_shares = (1 - BLEND) * codes.mass / by_kind + (BLEND / max(1, totals["n"])) * codes.mass.sum(1, keepdims=True)
        fresh = max(1.0, repeat_table[0][: REPEAT_SLOTS[0]].sum())  # training tokens that repeat nothing
        usual = min(0.9, (totals["once"] + 0.5) / (fresh + 1))
        at, parts, hashes, counts, shares = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, KINDS))
        spelled: np.ndarray = np.zeros(0)
        for (block, is_text), batch in _by_key(batches, 2):
            if block != at:
                at, parts, hashes = block, [], None
            if not is_text:
                blobs = zip(*[batch.column(i) for i in (5, 6, 7)])
                parts += [tuple(np.frombuffer(x.as_buffer(), t).copy() for x, t in zip(b, (np.uint64, np.int64, np.float32))) for b in blobs]
                continue
            if hashes is None:
                hashes = np.concatenate([p[0] for p in parts])
                order = np.argsort(hashes)
                hashes, counts = hashes[order], np.concatenate([p[1] for p in parts])[order]
                shares = (1 - BLEND) * np.concatenate([p[2] for p in parts]).reshape(-1, KINDS)[order] / by_kind.astype(np.float32)
                shares += (BLEND / max(1, totals["n"]) * counts)[:, None].astype(np.float32)
                spelled, parts = np.full(len(hashes), np.nan), []
            for row, end, raw, offsets in texts_of(batch.column(4)):
                t = Tokens(raw, offsets)
                which = np.searchsorted(hashes, t.hash)
                if (hashes[np.minimum(which, len(hashes) - 1)] != t.hash).any():
                    raise RuntimeError("a block changed between two reads; store the documents first")
                c = counts[which]
                new, first = np.unique(which[(c == 0) & np.isnan(spelled[which])], return_index=True)
                if len(new):
                    spot = np.flatnonzero((c == 0) & np.isnan(spelled[which]))[first]
                    lens = t.ends[spot] - t.starts[spot]
                    spelled[new] = spell_cost(_gathered(t.raw, t.starts[spot], lens), lens, shared_table.value, spell_mixer)
                slots_here, gate = t.repeat_contexts()
                again = repeat_mixer.predict([_stretch(repeat_table[0][s], repeat_table[1][s]) for s in slots_here], gate)
                again = np.where(t.place == 0, 0.0, again)
                unknown = (c == 0).astype(np.float64)
                other = 1.0 - t.repeats
                odd = (t.since_start(unknown * other) + PRIOR * usual) / (t.since_start(other) + PRIOR)
                known, kind = _known_share(t, shares[which], (c > 0) & (t.before == 0), by_kind / by_kind.sum())
                anew = np.where(c > 0, (1 - odd) * known, odd * 10.0 ** np.maximum(np.nan_to_num(spelled[which]), -290.0))
                p = np.where(t.before > 0, again * t.before / np.maximum(t.place, 1), (1 - again) * anew)
                code, contexts = t.codes()
                chance, level = codes.chances(code, kind, contexts)
                part = np.where(c > 0, shares[which, kind] / np.maximum(code_shares[code, kind], 1e-300), 0.0)
                p = averaged(t, p, chance * np.minimum(part, 1.0), level)
                cost = np.log10(np.maximum(p, 1e-300))
                plain = np.log10((c + 1) / (totals["n"] + totals["v"] + 1))
                n = end - row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2)[row:end], batch.column(3)[row:end], pa.array(np.diff(offsets)), pa.array(t.size.astype(np.int64)),
                        pa.array(np.bincount(t.text, c > 0, n).astype(np.int64)), pa.array(np.full(n, totals["n"])),
                        pa.array(np.bincount(t.text, plain, n)), pa.array(np.bincount(t.text, cost, n)),
                    ],
                    names,
                )

    names = ["doc_id", "learned", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id bigint, learned boolean, n_bytes bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = both.repartition("block").sortWithinPartitions("block", "order").mapInArrow(frugal(run), schema)
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")))


def _known_share(t: Tokens, shares: np.ndarray, new: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the words that are new to their text, among known words not yet in it, and the likeliest kind so far.

    Every kind of document has its own shares; the kinds are weighed by how well they predicted the text so far.
    """
    told, fair = np.zeros((KINDS, len(new))), np.zeros((KINDS, len(new)))
    fresh = np.flatnonzero(new)
    for k in range(KINDS):  # a row a kind, as what follows runs along tokens
        own = shares[:, k].astype(np.float64)
        own /= np.maximum(1 - t.since_start(np.where(new, own, 0)), 1e-9)
        fair[k] = own
        bits = np.zeros(len(own))
        bits[fresh] = np.log(np.maximum(own[fresh], 1e-300))
        told[k] = np.log(prior[k]) + t.since_start(bits)
    told -= told.max(0)
    weight = np.exp(told)
    total = mass = np.zeros(len(new))
    for k in range(KINDS):
        total, mass = total + weight[k], mass + weight[k] * fair[k]
    return np.minimum(mass / total, 1.0), told.argmax(0)


def _totals(table: DataFrame) -> tuple[int, ...]:
    """Tokens, distinct tokens and tokens seen once, of training rows, and tokens by kind of document."""
    names = ["n", "v", "once", *[f"k{i}" for i in range(KINDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(0)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(values[:, i]) for i in range(len(names))], names)

    found = table.filter(F.col("kind") == _TOTALS).select("hashes").mapInArrow(frugal(run), ", ".join(f"{c} bigint" for c in names))
    return tuple(found.agg(*[F.sum(c) for c in names]).first())


def held_out() -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 7, is 2."""
    return crc_mod("doc_id", 7) == 2


@query("op2_lm")
def op2(spark, folder):
    docs = narrowed(documents(spark, folder), ["doc_id", "text"])
    return score(docs, ~held_out()).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
