"""Language-model scores by online logistic context mixing.

The model predicts a text byte by byte and bit by bit, as its words with a blank after each; one more
blank (the empty word) ends the text. Hashed contexts of 0 to 6 preceding bytes of the text, across
its words, each predict the next bit from counts of 0 and 1. Their logits are combined by weights that are
gated by how well the longer contexts are known, and an adaptive map of (previous byte, probability)
refines the result. Weights and map are learned online, each bit predicted from counts that leave its
byte out. Every word, seen in training or not, has the product of its bits as its probability.

While a text is read, two memories of its own words and word pairs take a share of each prediction;
the shares are a few fixed settings among which the text decides (their mean probability is the
text's), so they adapt to texts that repeat themselves.

Scale: word and byte contexts are counted per task and merged by a shuffle; the tables of counts have
fixed sizes; the base scores of the ``frequent`` most frequent words and the byte scores of the
GRAMS most frequent contexts at most are sent to the tasks. The other words of a text meet their base
scores in a join, other contexts are scored where they are met. Training uses all texts outside the held-out fold.

Defined cases: a null text is the empty text (one end token); a null doc_id is trained on; repeated
rows are counted and scored one by one; without training texts all counts are 0 and the bit model
is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import LOWER_BYTES, fold, trimmed, whole
from traitscope.llm.tokens import slices
from traitscope.session import discard, materialise

FOLDS, HELD, FREQUENT = 7, 2, 1 << 18
#: Context lengths in bytes and the bits of their tables; together 4.3 million cells.
ORDERS, BITS = (0, 1, 2, 3, 4, 6), (10, 16, 19, 20, 20, 21)
OFFSETS = np.cumsum([0, *(1 << b for b in BITS)])
GATES, BUCKETS, HELD_BACK = 64, 33, 0.4
FLUSH = 200_000
#: Frequent contexts whose scores are sent to the tasks, bits of their table, and bytes taken at once.
GRAMS, SLOTS, PIECE = 1 << 21, 22, 1 << 20
#: Grams that are scored at once; their arrays stay in a core's cache.
STEP = 1 << 13
#: Tasks that learn weights side by side.
LEARNERS = 24
_U = np.uint64


# --- words of the corpus ---------------------------------------------------------------


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_BYTES).split()


def stream_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens of texts with a blank after each, and how many tokens each text has."""
    parts, counts = [], []
    for text in texts.cast(pa.binary()):
        words = words_of(text.as_py())
        words.append(b"")
        parts.append(b" ".join(words))
        counts.append(len(words))
    return np.frombuffer(b" ".join(parts) + b" ", np.uint8), np.array(counts)


def ends_of(data: np.ndarray) -> np.ndarray:
    """Where the tokens of a stream end; no token has a blank inside."""
    return np.flatnonzero(data == 32) + 1


def distinct_of(data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each token of a stream, and the distinct tokens by number."""
    ends = ends_of(data)
    buffers = [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)]
    coded = pa.Array.from_buffers(pa.binary(), len(ends), buffers).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), pc.binary_slice(coded.dictionary, 0, -1)


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held, text) -> (word, count in training texts, count in all texts); the empty word is the end."""
    kept: list[pa.Table] = []

    def merged() -> pa.Table:
        table = pa.concat_tables(kept).group_by("word").aggregate([("n", "sum"), ("m", "sum")])
        return table.select(["word", "n_sum", "m_sum"]).rename_columns(["word", "n", "m"])

    for batch in source:
        for a, b in slices(pc.binary_length(batch.column(1)).to_pylist()):
            data, sizes = stream_of(batch.column(1).slice(a, b - a))
            codes, words = distinct_of(data)
            train = np.repeat([not held for held in batch.column(0).slice(a, b - a).to_pylist()], sizes)
            counts = [pa.array(np.bincount(c, minlength=len(words))) for c in (codes[train], codes)]
            kept.append(pa.table([words, *counts], ["word", "n", "m"]))
            if sum(map(len, kept)) > FLUSH:
                kept = [merged()]
                if len(kept[0]) > FLUSH:
                    yield from kept.pop().to_batches()
    if kept:
        yield from merged().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, m) of a table (held, text): counts in training texts and in all."""
    counted = docs.select("held", "text").mapInArrow(trimmed(_count), "word binary, n long, m long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


# --- the bit model ----------------------------------------------------------------------


def _grams_at(data: np.ndarray, heads: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """The byte to predict (lowest) and up to 6 bytes before it, for the places a to b of texts from heads to ends."""
    low = max(a - 6, 0)
    part = data[low:b].astype(np.uint64)
    key = part.copy()
    for k in range(1, 7):
        key[k:] |= part[:-k] << _U(8 * k)
    own = slice(np.searchsorted(ends, a, "right"), np.searchsorted(heads, b))
    for r in range(6):
        at = heads[own] + r
        at = at[(at >= a) & (at < np.minimum(ends[own], b))]
        key[at - low] &= _U((1 << 8 * (r + 1)) - 1)
    return key[a - low :]


def _stream(tokens: list[bytes] | np.ndarray) -> np.ndarray:
    """Bytes of the tokens with a blank after each; a stream stays as it is."""
    return tokens if isinstance(tokens, np.ndarray) else np.frombuffer(b" ".join(tokens) + b" ", np.uint8)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte to predict (lowest) and up to 6 bytes before it, for each place of words that are texts of their own; their sizes."""
    data = _stream(words)
    ends = ends_of(data)
    sizes = np.diff(ends, prepend=0)
    return _grams_at(data, ends - sizes, ends, 0, len(data)), sizes


def grams_of_texts(tokens: list[bytes] | np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Grams of all places of texts of ``counts`` tokens, in pieces of bounded size."""
    data = _stream(tokens)
    ends = ends_of(data)[np.cumsum(counts) - 1]
    heads = np.r_[0, ends[:-1]]
    for a in range(0, len(data), PIECE):
        yield _grams_at(data, heads, ends, a, min(a + PIECE, len(data)))


def _slots(grams: np.ndarray) -> np.ndarray:
    mixed = (grams ^ (grams >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return (mixed >> _U(64 - SLOTS)).astype(np.int64)


def _contexts(grams: np.ndarray) -> np.ndarray:
    """Hashes (orders x grams) of the bytes before the predicted one."""
    out = np.empty((len(ORDERS), len(grams)), np.uint64)
    for i, order in enumerate(ORDERS):
        out[i] = (grams >> _U(8)) & _U((1 << 8 * order) - 1)
    out *= _U(0x9E3779B97F4A7C15)
    return out


def _cells(grams: np.ndarray, j: int, contexts: np.ndarray | None = None) -> np.ndarray:
    """Cells (orders x grams) of bit ``j`` of the predicted byte."""
    node = (_U(1) << _U(j)) | ((grams & _U(255)) >> _U(8 - j))
    mixed = (_contexts(grams) if contexts is None else contexts) + node
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(32)
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed >>= np.array([[64 - bits] for bits in BITS], np.uint64)
    out = mixed.view(np.int64)
    out += OFFSETS[:-1, None]
    return out


def _grams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (gram, n): how often; grams are counted in a table of the task, those without a slot by piece."""
    keys, counts = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64)

    def rows(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

    for batch in source:
        for a, b in slices(pc.binary_length(batch.column(0)).to_pylist()):
            for grams in grams_of_texts(*stream_of(batch.column(0).slice(a, b - a))):
                slots = _slots(grams)
                hit = (keys[slots] == grams) & (grams != 0)
                np.add.at(counts, slots[hit], 1)
                fresh, n = np.unique(grams[~hit], return_counts=True)
                slots = _slots(fresh)
                free = np.flatnonzero((keys[slots] == 0) & (fresh != 0))
                keys[slots[free]] = fresh[free]
                placed = keys[slots] == fresh
                placed &= fresh != 0
                counts[slots[placed]] += n[placed]
                if not placed.all():
                    yield rows(fresh[~placed], n[~placed])
    at = np.flatnonzero(counts)
    for a in range(0, len(at), 1 << 18):
        yield rows(keys[at[a : a + (1 << 18)]], counts[at[a : a + (1 << 18)]])


def _cell_counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) -> (cell, zeros, ones)."""
    table, some = np.zeros(2 * OFFSETS[-1], np.int64), False
    for batch in source:
        grams, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        some = some or len(grams) > 0
        contexts = _contexts(grams)
        for j in range(8):
            at = _cells(grams, j, contexts)
            at *= 2
            at += (grams >> _U(7 - j) & _U(1)).view(np.int64)
            for row in at:
                np.add.at(table, row, n)
    if some:
        zeros, ones = table[::2], table[1::2]
        at = np.flatnonzero(zeros + ones)
        for a in range(0, len(at), 1 << 18):
            part = at[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(zeros[part]), pa.array(ones[part])],
                ["cell", "zeros", "ones"],
            )


class BitModel:
    """Tables of counts, gated weights and the adaptive map."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        self.zeros, self.ones = zeros, ones
        self.weights = np.full((GATES, len(ORDERS)), 0.25)
        self.seen = np.zeros((256, BUCKETS))
        self.hit = np.zeros((256, BUCKETS))

    def inputs(self, grams: np.ndarray, j: int, leave: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits (orders x grams), gates and the bits; ``leave`` takes one occurrence out of the counts."""
        cells = _cells(grams, j)
        bit = (grams >> _U(7 - j) & _U(1)).astype(np.float64)
        n0, n1 = self.zeros[cells].astype(np.float64), self.ones[cells].astype(np.float64)
        if leave:
            n0, n1 = np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0)
        known = np.searchsorted([0.5, 2.5, 19.5], (n0 + n1)[[5, 4, 3]])
        gate = known[0] * 16 + known[1] * 4 + known[2]
        return np.log((n1 + HELD_BACK) / (n0 + HELD_BACK)), gate, bit

    def mix(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[gate].T * logits).sum(0), -11, 11)

    def learn(self, grams: np.ndarray, times: np.ndarray, batch: int = 2048, rate: float = 0.05) -> None:
        """One online pass: predict a batch from counts without it, then move weights and map."""
        power = np.full(self.weights.shape, 1e-3)
        for at in range(0, len(grams), batch):
            part, n = grams[at : at + batch], times[at : at + batch].astype(np.float64)
            before = (part >> _U(8) & _U(255)).astype(np.int64)
            for j in range(8):
                logits, gate, bit = self.inputs(part, j, leave=True)
                mixed = self.mix(logits, gate)
                p = 1 / (1 + np.exp(-mixed))
                step = np.stack([np.bincount(gate, n * (bit - p) * s, GATES) for s in logits], 1)
                step /= np.maximum(np.bincount(gate, n, GATES), 1)[:, None]
                power += step * step
                self.weights += rate * step / np.sqrt(power)
                bucket = np.rint((mixed + 8) * 2).clip(0, BUCKETS - 1).astype(np.int64)
                place = before * BUCKETS + bucket
                self.seen += np.bincount(place, n, self.seen.size).reshape(self.seen.shape)
                self.hit += np.bincount(place, n * bit, self.hit.size).reshape(self.hit.shape)

    def refined(self) -> np.ndarray:
        """The adaptive map as logits; cells with little evidence stay near their own logit."""
        own = 1 / (1 + np.exp(-(np.arange(BUCKETS) / 2 - 8)))
        p = (self.hit + 50 * own) / (self.seen + 50)
        return np.log(p / (1 - p))

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the bit model's probability of each word and its end, as a text of its own."""
        if not words:
            return np.empty(0)
        keys, sizes = grams_of(words)
        grams, inverse = np.unique(keys, return_inverse=True)
        return np.add.reduceat(self.of_grams(grams)[inverse], np.cumsum(sizes) - sizes)

    def frozen(self) -> Frozen:
        known = np.searchsorted([0.5, 2.5, 19.5], self.zeros + self.ones).astype(np.uint8)
        for i in (4, 5):
            known[OFFSETS[i] : OFFSETS[i + 1]] *= 4 ** (i - 3)
        logits = np.log((self.ones + HELD_BACK) / (self.zeros + HELD_BACK)).astype(np.float32)
        return Frozen(logits, known, self.weights, self.refined())

    def of_grams(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        return self.frozen().of_grams(grams)


@dataclass
class Frozen:
    """What a learned model needs to score: logit and share of the gate of every cell, weights, map."""

    logits: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    map: np.ndarray

    def of_grams(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        total, weights = np.empty(len(grams)), np.ascontiguousarray(self.weights.T)
        table = self.map.ravel()
        for a in range(0, len(grams), STEP):
            part = grams[a : a + STEP]
            before = (part >> _U(8) & _U(255)).astype(np.int64) * BUCKETS
            contexts, p = _contexts(part), np.ones(len(part))
            for j in range(8):
                cells = _cells(part, j, contexts)
                gate = self.known[cells[3]] + self.known[cells[4]] + self.known[cells[5]]
                mixed = weights[0][gate] * self.logits[cells[0]]
                for w, cell in zip(weights[1:], cells[1:]):
                    mixed += w[gate] * self.logits[cell]
                np.clip(mixed, -11, 11, mixed)
                place = ((mixed + 8) * 2).clip(0, BUCKETS - 1.001)
                low = place.astype(np.int64)
                place -= low
                low += before
                mixed += table[low] * (1 - place) + table[low + 1] * place
                # Half of the sum is the last logit; with its sign turned for a bit of 1.
                mixed *= 0.5 - (part >> _U(7 - j) & _U(1)).view(np.int64)
                p /= 1 + np.exp(mixed)
            total[a : a + len(part)] = np.log10(p)
        return total


def _learn(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n) in any order -> the weights and map sums learned from the rows of a task."""
        model, total = BitModel(*shared.value), 0
        for batch in source:
            grams, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(grams * _U(0x9E3779B97F4A7C15), kind="stable")
            model.learn(grams[order], n[order])
            total += int(n.sum())
        if total:
            learned = [(x.astype(np.float64).tobytes(),) for x in (model.weights, model.seen, model.hit)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([total], pa.int64()), *(pa.array(list(x), pa.binary()) for x in learned)], ["total", "weights", "seen", "hit"]
            )

    return run


def train(texts: DataFrame) -> tuple[BitModel, DataFrame]:
    """The bit model of the training texts, and the written table (gram, n) of their grams.

    The driver receives the tables (at most 4.3 million cells), and the weights and map of each of
    LEARNERS tasks (140 KB each), which are averaged by their evidence.
    """
    grams = texts.select("text").mapInArrow(trimmed(_grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "lm-grams")
    cells = grams.mapInArrow(trimmed(_cell_counts), "cell int, zeros long, ones long").groupBy("cell")
    table = cells.agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones")).toArrow()
    counts = [np.zeros(OFFSETS[-1], np.float32), np.zeros(OFFSETS[-1], np.float32)]
    at = table["cell"].to_numpy()
    for out, name in zip(counts, ("zeros", "ones")):
        out[at] = table[name].to_numpy()
    model = BitModel(*counts)
    shared = grams.sparkSession.sparkContext.broadcast(tuple(counts))
    rows = grams.repartition(LEARNERS, "gram").mapInArrow(trimmed(_learn(shared)), "total long, weights binary, seen binary, hit binary").collect()
    if rows:
        every = sum(r["total"] for r in rows)
        model.weights = sum(r["total"] / every * np.frombuffer(r["weights"]).reshape(GATES, -1) for r in rows)
        model.seen, model.hit = (sum(np.frombuffer(r[x]).reshape(256, BUCKETS) for r in rows) for x in ("seen", "hit"))
    shared.destroy()
    return model, grams


# --- scores of words and texts --------------------------------------------------------


def _score_grams(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n) -> (gram, n, score)."""
        for batch in source:
            score = shared.value.of_grams(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], ["gram", "n", "score"])

    return run


def gram_table(grams: DataFrame, model, most: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Grams and scores of the ``most`` most frequent grams at most, by frequency."""
    often = grams.where(F.col("n") >= most_frequent(grams, most, "n"))
    table = often.mapInArrow(trimmed(_score_grams(model)), "gram long, n long, score double").toArrow()
    order = np.lexsort((table["gram"].to_numpy(), table["n"].to_numpy()))
    return table["gram"].to_numpy().view(np.uint64)[order], table["score"].to_numpy()[order]


def in_slots(grams: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table of ``gram_table``'s rows, each in its slot; of one slot's the last."""
    keys, values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS)
    at = _slots(grams)
    keys[at] = grams
    at = np.flatnonzero(keys[at] == grams)
    values[_slots(grams[at])] = scores[at]
    return keys, values


def token_scores(model: BitModel | Frozen, keys: np.ndarray, scores: np.ndarray, tokens: list[bytes] | np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each token of texts of ``counts`` tokens, after the bytes before it."""
    data = _stream(tokens)
    places = np.empty(len(data))
    for a, grams in zip(range(0, len(data), PIECE), grams_of_texts(data, counts)):
        slots = _slots(grams)
        out = scores[slots]
        other = np.flatnonzero((keys[slots] != grams) | (grams == 0))
        fresh, inverse = np.unique(grams[other], return_inverse=True)
        out[other] = model.of_grams(fresh)[inverse]
        places[a : a + len(grams)] = out
    return np.add.reduceat(places, np.r_[0, ends_of(data)[:-1]])


#: Shares of the two memories of a text, its words and its word pairs, among which the text itself decides.
MEMORY = ((0, 0), (0.05, 0), (0.2, 0), (0.1, 0.2), (0.05, 0.6), (0.02, 0.93))
SUMS = [f"s{k}" for k in range(len(MEMORY))]
TEXT = ", ".join(
    ["uid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double", *(f"{s} double" for s in SUMS), "word binary, times int"]
)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key stands before its place."""
    n = len(keys)
    if n and int(keys.max()) < (1 << 62) // n:
        # Sorted with their places as last digits; much faster than a stable sort of places.
        ranked, order = np.divmod(np.sort(keys * n + np.arange(n)), n)
    else:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.repeat(heads, np.diff(np.r_[heads, n]))
    return out


def memory_sums(codes: np.ndarray, heads: np.ndarray, sizes: np.ndarray, static: np.ndarray) -> np.ndarray:
    """log10 sums (texts x MEMORY) of texts given by word codes from 0; ``static`` is 0 for words scored elsewhere.

    A word that the text has not had yet and whose static probability comes from the join counts with
    the share that the static model keeps; one that it had counts with the memories alone.
    """
    n = len(codes)
    doc = np.repeat(np.arange(len(heads)), sizes)
    at = np.arange(n) - np.repeat(heads, sizes)
    wide = np.int64(codes.max() + 1 if n else 1)
    before = _earlier(doc * wide + codes)
    single = before / np.maximum(at, 1)
    pair = np.zeros(n)
    if n > 1:
        follows = np.flatnonzero(at > 0)
        key = np.unique(doc[follows] * wide + codes[follows - 1], return_inverse=True)[1] * wide + codes[follows]
        pair[follows] = _earlier(key) / np.maximum(before[follows - 1], 1)
    out = np.empty((len(heads), len(MEMORY)))
    elsewhere = static == 0
    for k, (one, two) in enumerate(MEMORY):
        p = (1 - one - two) * static + one * single + two * pair
        p[elsewhere & (p == 0)] = 1 - one - two
        if not one:
            p[elsewhere] = 1
        out[:, k] = np.add.reduceat(np.log10(p), heads)
    return out


def _score_texts(shared, model):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a row with its scores and the base sum over frequent words, and a row for each other distinct word."""
        at, known, base, *often = shared.value
        keys, scores = in_slots(*often)
        names = [x.split()[0] for x in TEXT.split(", ")]
        for batch in source:
            for a, b in slices(pc.binary_length(batch.column(3)).to_pylist()):
                part = batch.slice(a, b - a)
                data, size = stream_of(part.column(3))
                codes, words = distinct_of(data)
                n, heads, wide = len(part), np.cumsum(size) - size, len(words)
                # No word has a blank inside; to_pylist takes ten times as long.
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, wide], pa.int32()), words), b" ")[0].as_py()
                place = np.fromiter(map(at.get, joined.split(b" "), repeat(-1)), np.int64, wide)
                own = token_scores(model.value, keys, scores, data, size)
                # A very long word's probability is below the smallest double.
                far = own < -300
                sums = memory_sums(codes, heads, size, np.where(far, 0, 10.0**own))
                if far.any():
                    text = np.repeat(np.arange(n), size)
                    first = _earlier(text * wide + codes) == 0
                    sums[:, 0] += np.bincount(text[far], own[far], n)
                    sums[:, 1:] += np.bincount(text[far & first], own[far & first], n)[:, None]
                n_known = np.add.reduceat(np.where(place >= 0, np.append(known, False)[place], False).astype(np.int64)[codes], heads)
                base_sum = np.add.reduceat(np.where(place >= 0, np.append(base, 0.0)[place], 0.0)[codes], heads)
                lengths = pc.binary_length(part.column(3)).cast(pa.int64())
                counts = [lengths, pa.array(size), pa.array(n_known), pa.array(base_sum), *(pa.array(c) for c in sums.T.copy())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *counts, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], names)
                rare = np.flatnonzero((place < 0)[codes])
                pairs, times = np.unique((np.searchsorted(heads, rare, "right") - 1) * wide + codes[rare], return_counts=True)
                own = pa.array(pairs // wide)
                blank = [pa.nulls(len(pairs), c.type) for c in (part.column(1), part.column(2), *counts)]
                rows = words.take(pa.array(pairs % wide))
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), *blank, rows, pa.array(times.astype(np.int32))], names)

    return run


def most_frequent(words: DataFrame, most: int, m: str = "m") -> int:
    """The least count ``m`` that ``most`` words at most reach; decided on at most 4096 rows."""
    rows = words.groupBy(F.least(m, F.lit(4096)).alias("least")).agg(F.count("*").alias("words"), F.sum(m).alias("mass")).collect()
    total, least = 0, None
    for r in sorted(rows, key=lambda r: -r["least"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    # More than ``most`` words of 4096 and more: a share of 1/most of all tokens bounds their number.
    return least if least is not None else -(-sum(r["mass"] for r in rows) // most) + 1


def score_texts(docs: DataFrame, folds: int = FOLDS, held: int = HELD, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs``.

    ``bits_per_byte`` is the length of the text under the model, per byte of the text and its end.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", folds) == held).alias("held"),
        whole().alias("text"),
    )
    words = materialise(word_counts(texts), "lm-words")
    tokens, kinds = (int(x) for x in words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first())
    context = spark.sparkContext
    learned, grams = train(texts.where("not held"))
    model = context.broadcast(learned.frozen())
    table = gram_table(grams, model)
    discard(grams)
    scored = words.withColumn("base", F.log10((F.col("n") + 1) / F.lit(float(tokens + kinds + 1))))
    often = scored.where(F.col("m") >= most_frequent(words, frequent)).toArrow()
    lookup = dict(zip(often["word"].to_pylist(), range(len(often))))
    shared = context.broadcast((lookup, often["n"].to_numpy() > 0, often["base"].to_numpy(), *table))
    rows = materialise(texts.mapInArrow(trimmed(_score_texts(shared, model)), TEXT), "lm-texts")
    # Every machine has a file of a broadcast until it is destroyed.
    for sent in (model, shared):
        sent.destroy()
    other = rows.where(F.col("word").isNotNull()).select("uid", "word", "times")
    other = other.join(scored.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held_out", "boolean"), ("n_bytes", "long"), ("n_tokens", "long"))]
    other = other.select(
        "uid",
        *nothing,
        F.when(F.col("n") > 0, F.col("times").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_known"),
        (F.col("times") * F.col("base")).alias("base"),
        *[F.lit(None).cast("double").alias(s) for s in SUMS],
    )
    both = rows.where(F.col("word").isNull()).drop("word", "times").unionByName(other)
    total = both.groupBy("uid").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_bytes", "n_tokens")],
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"),
        *[F.sum(s).alias(s) for s in SUMS],
    )
    best = F.greatest(*SUMS)
    mean = sum((F.pow(F.lit(10.0), F.col(s) - best) for s in SUMS), F.lit(0.0)) / len(SUMS)
    total = total.withColumn("score", best + F.log10(mean))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte")
    )
