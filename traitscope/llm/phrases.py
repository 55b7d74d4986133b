"""Phrase collocations by stripes: every prefix keys a counter of the words that follow it.

For every language, phrases of 2 to 5 words that occur ``ENOUGH`` times or more are scored by their worst
cut, floor(1000 * a * n / (l * r)), and those that occur only inside a longer one are dropped.

Method. A stripe is (language, prefix) -> {next word: count}; the empty prefix has the words
themselves. A task keeps the words of its texts as numbers, counts all (prefix, next) of a level with
array sorts, and emits its stripes; stripes of a prefix are merged element by element. From the merged
stripes come the frequent extensions (counts of ``ENOUGH`` or more), the prefixes' totals (n as the sum
of the empty prefix's stripe, others as the entry of the prefix in the stripe one word shorter) and the
largest extension, which tells whether a prefix is subsumed on its right; the same entries, keyed without
their first word, tell about the left.

Two filters of fixed size limit a level; both let more through when they are full, never less, so they
change work, not results (counts are of the words themselves). One has the frequent phrases of the level
below: both parts of a phrase must be in it. The other has the phrases' own hash buckets: while a level
is counted, the next level's phrases are counted by bucket (``BUCKET_BITS`` bits of their hash, up to
``ENOUGH``), as compressed runs of numbers that are added up range by range; only buckets that reach
``ENOUGH`` may enter a stripe. So rare phrases cost a byte or two each in the shuffle, not their words.
The texts are read twice; the second reading writes the stretches of possible pairs, which the levels
above read.

Skew. A task combines its counts before it emits, so a common prefix has one stripe per task, however
often it occurs. The stripe of a common word may be as large as the vocabulary: stripes are cut by a hash
of the next word into ``PARTS`` parts. Stripes travel in ``BUNDLES`` bundles a task, by a hash of prefix
and part, so their rows do not grow with the number of phrases; a bundle at a time is merged. Scores
and cuts are joined by phrase, and the first ``TOP`` of a language are chosen per slice of it first.
A task holds ``HELD`` bytes of text, but for a longer single text, with some ten numbers a word.

Cases: a null lang is ``und``, a null text empty. Repeated rows count as often as they stand there; ids
do not matter. Very long texts are whole. Ties: equal scores go by count, then by the phrase's UTF-8
bytes; of equal cuts the smallest counts. Scores are computed in integers of any size. Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscope.llm.common import salted_join, trimmed, whole
from traitscope.session import materialise

LONGEST, ENOUGH, TOP = 5, 100, 2000
#: Parts of a stripe by the number of words of its phrases; short prefixes have long stripes.
PARTS = {1: 512, 2: 16, 3: 4, 4: 4, 5: 4}
#: Bundles of stripes that a task emits for a level and language at most.
BUNDLES = 1024
#: Bits of the filter of frequent phrases, of the buckets' numbers, and of a bucket's number in its range.
FILTER_BITS, BUCKET_BITS, RANGE_BITS = 27, 28, 20
#: Bytes of text that a task holds before it counts them.
HELD = 24_000_000
#: Slices of a language when its first phrases are chosen.
SLICES = 32

#: Bytes as words are read: A-Z lowered, ends of pieces as a line feed, a tab as a blank.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[*b".,;:!?", 10, 11, 12, 13]] = 10
_BYTES[9] = 32

_U = np.uint64


# --- numbers for words ---------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def join_hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all words but the last, and the last word's."""
    with np.errstate(over="ignore"):
        return _mix(first * _U(0xD6E8FEB86659FD93) + last)


def slots(hashes: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64)


class Words:
    """The words of some texts of a language: ``ids`` into ``names`` and ``hashes``; ``linked`` if the next word is in the same piece."""

    def __init__(self, lang: str, texts: list[str]):
        data = _BYTES[np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)]
        ends = data == 10
        blank = ends | (data == 32)
        edge = np.diff(np.r_[True, blank, True].view(np.int8))
        starts = np.flatnonzero(edge == -1)
        lengths = np.flatnonzero(edge == 1) - starts
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        piece = np.cumsum(ends, dtype=np.int32)[starts]
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[~blank]))
        coded = flat.dictionary_encode()
        self.lang, self.ids = lang, coded.indices.to_numpy(zero_copy_only=False)
        self.names = coded.dictionary.cast(pa.string())
        self.linked = np.r_[piece[1:] == piece[:-1], np.zeros(min(len(piece), 1), dtype=bool)]
        with np.errstate(over="ignore"):
            self.hashes = _mix(word_hash(self.names.to_pylist()) + word_hash([lang])[0])

    def windows(self, filters: dict, level: int):
        """(passes, hashes) of the window of ``level`` words from each word.

        A window passes if it is inside a piece, both its shorter windows pass, and it is in the filter of its own length.
        """
        base = self.hashes[self.ids]
        ok, h = np.ones(len(base), dtype=bool), base
        for m in range(1, level + 1):
            if m > 1:
                shorter, below = ok, h
                ok = np.zeros(len(base), dtype=bool)
                ok[:-1] = shorter[:-1] & shorter[1:]
                if m == 2:
                    ok &= self.linked
                at, h = np.flatnonzero(ok), np.zeros(len(base), dtype=np.uint64)
                h[at] = join_hash(below[at], base[at + m - 1])
            for lookup in filters.get(m, ()):
                at = np.flatnonzero(ok)
                ok[at] = lookup(h[at])
        return ok, h


def held_words(source):
    """Batches (lang, text) -> Words whenever HELD bytes are together, and at the end."""
    held, size = {}, 0
    for batch in source:
        for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= HELD:
                yield from (Words(k, held.pop(k)) for k in list(held))
                size = 0
    yield from (Words(k, held.pop(k)) for k in list(held))


# --- stripes and buckets -------------------------------------------------------------------


def _numbered(ids, starts, n: int):
    """A number per different run of ``n`` words at ``starts``, and one start for each number."""
    if not n:
        return np.zeros(len(starts), dtype=np.int64), starts[:1]
    code = ids[starts].astype(np.int64)
    for k in range(1, n):
        _, code = np.unique(code, return_inverse=True)
        code = (code << 32) + ids[starts + k]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, starts[first]


def stripe_batches(words: Words, ok, level: int):
    """Stripes of one task as batches."""
    starts = np.flatnonzero(ok)
    if not len(starts):
        return
    nexts = words.ids[starts + level - 1].astype(np.int64)
    prefix, at = _numbered(words.ids, starts, level - 1)
    code, count = np.unique((prefix << 32) + nexts, return_counts=True)
    prefix, nexts = code >> 32, code & ((1 << 32) - 1)
    key = np.zeros(len(at), dtype=np.uint64)
    if level > 1:
        key = words.hashes[words.ids[at]]
        for k in range(1, level - 1):
            key = join_hash(key, words.hashes[words.ids[at + k]])
    with np.errstate(over="ignore"):
        bundle = ((key[prefix] + words.hashes[nexts] % _U(PARTS[level])) % _U(BUNDLES)).astype(np.int32)
    order = np.lexsort((prefix, bundle))
    prefix, nexts, bundle, count = prefix[order], nexts[order], bundle[order], count[order]
    new = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (bundle[1:] != bundle[:-1])])
    first = np.flatnonzero(np.r_[True, bundle[new][1:] != bundle[new][:-1]])
    spelled = [words.names.take(pa.array(words.ids[at + k])) for k in range(level - 1)]
    spelled = pc.binary_join_element_wise(*spelled, " ") if spelled else pa.array([""])
    inside = pa.array(np.r_[new, len(prefix)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(inside, x) for x in (words.names.take(pa.array(nexts)), pa.array(count))]
    stripes_ = pa.StructArray.from_arrays([spelled.take(pa.array(prefix[new])), *lists], ["prefix", "nexts", "counts"])
    held = pa.ListArray.from_arrays(pa.array(np.r_[first, len(new)].astype(np.int32)), stripes_)
    for i in range(0, len(first), 128):
        some = held.slice(i, 128)
        yield {"lang": pa.array([words.lang] * len(some)), "part": pa.array(bundle[new[first[i : i + 128]]]), "stripes": some}


def _pack(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers below 2^32 and counts up to 255, compressed; the numbers as steps, byte by byte."""
    steps = np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(np.r_[steps, counts.astype(np.uint8)[None]]).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int):
    planes = np.frombuffer(pa.decompress(blob, 5 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(5, n)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel().astype(np.int64)), planes[4]


def bucket_batches(words: Words, ok, h, level: int):
    """Buckets of the phrases one word longer whose both parts pass, counted up to ENOUGH, range by range."""
    longer = np.zeros(len(ok), dtype=bool)
    longer[:-1] = ok[:-1] & ok[1:]
    if level == 1:
        longer &= words.linked
    at = np.flatnonzero(longer)
    if not len(at):
        return
    found = slots(join_hash(h[at], words.hashes[words.ids[at + level]]), BUCKET_BITS).astype(np.uint32)
    numbers, counts = np.unique(found, return_counts=True)
    counts = np.minimum(counts, ENOUGH)
    which = numbers >> np.uint32(RANGE_BITS)
    edges = np.r_[np.flatnonzero(np.r_[True, which[1:] != which[:-1]]), len(numbers)]
    spans = list(zip(edges[:-1], edges[1:]))
    inner = numbers & np.uint32((1 << RANGE_BITS) - 1)
    yield {
        "part": pa.array([int(which[a]) for a, _ in spans], pa.int32()),
        "size": pa.array([int(b - a) for a, b in spans], pa.int32()),
        "blob": pa.array([_pack(inner[a:b], counts[a:b]) for a, b in spans], pa.binary()),
    }


def stretch_batches(words: Words, pairs):
    """The stretches in which every pair passes and that have three words at least, as texts of one line each."""
    starts = np.flatnonzero(pairs)
    if not len(starts):
        return
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]] + 1
    long = last - first > 1
    first, last = first[long], last[long]
    size = last - first + 1
    ends = np.cumsum(size)
    if not len(ends):
        return
    at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
    named = words.names.take(pa.array(words.ids[at]))
    for i in range(0, len(ends), 50_000):
        stop = ends[i : i + 50_000]
        begin = stop[0] - size[i]
        part = pa.ListArray.from_arrays(pa.array(np.r_[0, stop - begin].astype(np.int32)), named.slice(begin, stop[-1] - begin))
        lines = pc.binary_join(part, " ")
        yield {"lang": pa.array([words.lang]), "text": pa.array(["\n".join(lines.to_pylist())])}


#: What one reading of the texts writes: stripes (kind 0), buckets (1) and stretches (2).
_PASS = {
    "kind": pa.int32(), "lang": pa.string(), "part": pa.int32(),
    "stripes": pa.list_(pa.struct([("prefix", pa.string()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])),
    "size": pa.int32(), "blob": pa.binary(), "text": pa.string(),
}
PASS = "kind int, lang string, part int, stripes array<struct<prefix:string,nexts:array<string>,counts:array<bigint>>>, size int, blob binary, text string"


def _filled(kind: int, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), **columns}
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in _PASS.items()], list(_PASS))


def _reading(level: int, shared: dict):
    """One pass over texts: stripes of ``level``, buckets of the next one, and after the pairs the stretches."""

    def run(source):
        filters = {m: [_lookup(f) for f in several] for m, several in shared.items()}
        for words in held_words(source):
            if not len(words.ids):
                continue
            ok, h = words.windows(filters, level)
            yield from (_filled(0, x) for x in stripe_batches(words, ok, level))
            if level < LONGEST:
                yield from (_filled(1, x) for x in bucket_batches(words, ok, h, level))
            if level == 2:
                yield from (_filled(2, x) for x in stretch_batches(words, ok))

    return run


STRIPE = "lang string, prefix string, part int, nexts array<string>, counts array<long>"
_STRIPE = [("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("nexts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]


def _batches(rows, fields, most=20_000, entries=200_000):
    """Rows as batches; a row's fourth field is a list whose entries count."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[3]) if isinstance(row[3], list) else 1
        if len(out) >= most or size >= entries:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])


def _merged(source):
    """Sorted bundles -> merged stripes: total, and the extensions met ENOUGH times."""
    key, counters = None, {}

    def done():
        for prefix, counter in counters.items():
            kept = [(w, c) for w, c in counter.items() if c >= ENOUGH]
            yield key[0], prefix, key[1], [w for w, _ in kept], [c for _, c in kept], sum(counter.values())

    def rows():
        nonlocal key, counters
        for batch in source:
            for lang, part, several in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (lang, part):
                    if key is not None:
                        yield from done()
                    key, counters = (lang, part), {}
                for stripe in several:
                    counter = counters.setdefault(stripe["prefix"], {})
                    for w, c in zip(stripe["nexts"], stripe["counts"]):
                        counter[w] = counter.get(w, 0) + c
        if key is not None:
            yield from done()

    yield from _batches(rows(), [*_STRIPE, ("total", pa.int64())])


def stripes(read: DataFrame, level: int) -> DataFrame:
    """Merged stripes of one reading: a written table."""
    own = read.where("kind = 0").select("lang", "part", "stripes")
    dealt = own.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return materialise(dealt.mapInArrow(trimmed(_merged), f"{STRIPE}, total long"), f"phrases-stripes{level}")


# --- the filters ---------------------------------------------------------------------------


def _slot_rows(source):
    for batch in source:
        lang, prefix, nexts = [c.to_pylist() for c in batch.columns]
        rows = [[*p.split(" "), w] if p else [w] for p, w in zip(prefix, nexts)]
        if not rows:
            continue
        with np.errstate(over="ignore"):
            add = word_hash(lang)
            columns = [_mix(word_hash(c) + add) for c in zip(*rows)]
        h = columns[0]
        for last in columns[1:]:
            h = join_hash(h, last)
        yield pa.RecordBatch.from_arrays([pa.array(slots(h))], ["slot"])


def frequent_filter(extensions: DataFrame):
    """A broadcast bitmap of FILTER_BITS bits over (lang, prefix, word); OR-ed in words of 64 bits before it is collected."""
    at = extensions.select("lang", "prefix", "word").mapInArrow(trimmed(_slot_rows), "slot long")
    cells = at.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    cells = cells.toArrow()
    return extensions.sparkSession.sparkContext.broadcast((FILTER_BITS, cells["cell"].to_numpy(), cells["bits"].to_numpy()))


def _reached(source):
    """Sorted buckets -> per range the bits of those that reach ENOUGH, as (cell, bits) of 64."""
    now, sums = None, None

    def done():
        bits = np.packbits(sums >= ENOUGH, bitorder="little").view("<i8")
        cells = np.flatnonzero(bits)
        start = now << (RANGE_BITS - 6)
        return pa.RecordBatch.from_arrays([pa.array(cells + start), pa.array(bits[cells])], ["cell", "bits"])

    for batch in source:
        for part, size, blob in zip(*[c.to_pylist() for c in batch.columns]):
            if part != now:
                if now is not None:
                    yield done()
                now, sums = part, np.zeros(1 << RANGE_BITS, dtype=np.uint16)
            numbers, counts = _unpack(blob, size)
            sums[numbers] = np.minimum(sums[numbers] + counts, ENOUGH)
    if now is not None:
        yield done()


def bucket_filter(read: DataFrame):
    """A broadcast bitmap of BUCKET_BITS bits: the buckets of one reading that reach ENOUGH."""
    own = read.where("kind = 1").select("part", "size", "blob").repartition("part").sortWithinPartitions("part")
    cells = own.mapInArrow(trimmed(_reached), "cell long, bits long").toArrow()
    return read.sparkSession.sparkContext.broadcast((BUCKET_BITS, cells["cell"].to_numpy(), cells["bits"].to_numpy()))


def _lookup(shared):
    """Hashes -> whether their slot is set in a broadcast bitmap."""
    bits, cells, values = shared.value
    flags = np.zeros(1 << (bits - 6), dtype=np.int64)
    flags[cells] = values

    def lookup(hashes):
        at = slots(hashes, bits)
        return ((flags[at >> 6] >> (at & 63)) & 1).astype(bool)

    return lookup


# --- phrases -------------------------------------------------------------------------------


def extensions(merged: DataFrame) -> DataFrame:
    """lang, prefix, word, f: the frequent phrases of a level, from its merged stripes."""
    pairs = F.explode(F.arrays_zip("nexts", "counts")).alias("e")
    return merged.select("lang", "prefix", pairs).select("lang", "prefix", F.col("e.nexts").alias("word"), F.col("e.counts").alias("f"))


_SCORES = [("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("score", pa.int64())]


def worst_cut(a: int, n: int, left: list[int], right: list[int]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut, the smallest of equal ones; ``left[k - 1]`` counts the first k words, ``right[k - 1]`` the last k."""
    cuts = [(1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(zip(left, reversed(right)))]
    score, _, l, r = min(cuts)
    return score, l, r


def _score_rows(source):
    def rows():
        for batch in source:
            for lang, phrase, a, n, left, right in zip(*[c.to_pylist() for c in batch.columns]):
                score, l, r = worst_cut(a, n, left, right)
                yield lang, phrase, a, l, r, n, score

    yield from _batches(rows(), _SCORES)


def mine_phrases(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written tables of the phrases of 1, 2, ... LONGEST words (lang, phrase, f, left, right, subsumed), and (lang, n).

    ``left`` counts the first 1, 2, ... words of a phrase and ``right`` the last ones, the phrase itself
    left out; ``subsumed`` tells whether one more word on either side is always the same.
    """
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole().alias("text"))
    shared, tables, sizes = {}, [], None
    for level in range(1, LONGEST + 1):
        read = materialise(source.mapInArrow(trimmed(_reading(level, shared)), PASS), f"phrases-pass{level}")
        merged = stripes(read, level)
        found = extensions(merged)
        tables.append((merged, found))
        if level == 1:
            sizes = materialise(merged.groupBy("lang").agg(F.sum("total").alias("n")), "phrases-sizes")
        if level == 2:
            source = read.where("kind = 2").select("lang", "text")
        if level < LONGEST:
            shared = {**shared, level: [frequent_filter(found)], level + 1: [bucket_filter(read)]}
    return _counted(tables), sizes


def _counted(levels) -> list[DataFrame]:
    """Frequent phrases with the counts of all their parts, level by level, and whether they are subsumed."""
    out, below = [], None
    none = F.array().cast("array<long>")
    for m, (merged, found) in enumerate(levels, 1):
        phrase = F.col("word") if m == 1 else F.concat_ws(" ", "prefix", "word")
        rows = found.select("lang", "prefix", phrase.alias("phrase"), "f")
        if m == 1:
            rows = rows.select("lang", "phrase", "f", none.alias("left"), none.alias("right"))
        else:
            tail = F.expr("substring(phrase, locate(' ', phrase) + 1)")
            heads = below.select("lang", F.col("phrase").alias("prefix"), F.concat("left", F.array("f")).alias("left"))
            tails = below.select("lang", F.col("phrase").alias("tail"), F.concat("right", F.array("f")).alias("right"))
            rows = rows.withColumn("tail", tail).join(heads, ["lang", "prefix"]).join(tails, ["lang", "tail"])
            rows = rows.select("lang", "phrase", "f", "left", "right")
        if m < len(levels):
            above_merged, above = levels[m]
            most = F.max(F.array_max("counts"))
            right = above_merged.groupBy("lang", F.col("prefix").alias("phrase")).agg(most.alias("right_most"))
            shorter = F.col("word") if m == 1 else F.concat_ws(" ", F.expr("substring(prefix, locate(' ', prefix) + 1)"), F.col("word"))
            left = above.groupBy("lang", shorter.alias("phrase")).agg(F.max("f").alias("left_most"))
            rows = rows.join(right, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
            most = F.greatest(F.coalesce("right_most", F.lit(0)), F.coalesce("left_most", F.lit(0)))
            rows = rows.select("lang", "phrase", "f", "left", "right", (most >= F.col("f")).alias("subsumed"))
        else:
            rows = rows.withColumn("subsumed", F.lit(False))
        below = materialise(rows, f"phrases-level{m}")
        out.append(below)
    return out


def phrase_collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first TOP phrases of every language."""
    levels, sizes = mine_phrases(docs)
    rows = None
    for table in levels[1:]:
        table = table.where(~F.col("subsumed"))
        rows = table if rows is None else rows.unionByName(table)
    rows = salted_join(rows, sizes, ["lang"], F.xxhash64("phrase"), written=True).select("lang", "phrase", F.col("f").alias("a"), "n", "left", "right")
    scored = rows.mapInArrow(trimmed(_score_rows), "lang string, phrase string, a long, l long, r long, n long, score long")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(SLICES))
    best = scored.withColumn("_slice", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order)))
    best = best.where(F.col("rank") <= TOP)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
