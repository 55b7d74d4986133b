"""Substring deduplication by MinHash banding of content-anchored paragraphs.

A repeated passage may stand anywhere in a line, so a paragraph is not a line: it is ``PARAGRAPH``
words that start at a winnowed anchor. Of every ``PASSAGE - PARAGRAPH + 1`` consecutive start
positions the one with the least hash is an anchor, so two documents that share ``PASSAGE`` words
share a paragraph, wherever the passage stands.

1. MinHash signatures of the paragraphs' 5-word shingles make band keys; the number of bands is the
   least that finds a pair of the given similarity with the given recall.
2. Band keys are counted with a map-side combine. Keys met once are of no interest; a bitmap of
   fixed size of the others keeps most paragraphs out of the shuffle that follows, and a join
   decides exactly (a full bitmap lets more through, never less).
3. Distinct paragraphs of a key are compared by exact Jaccard similarity, in blocks of bounded size;
   a block yields at most one link per paragraph. Equal paragraphs need no comparison.
4. Components of the links are clusters. The paragraphs of a cluster's first document (smallest
   doc_id, then text hash) stay, those of its other documents are removed.
   Paragraphs of a document that touch are merged, and with the words between them those on one
   diagonal of one first document.
5. Anchors leave up to ``GAP`` words at either end of a passage. Around the paragraphs near the ends
   of a merged run every window of ``PARAGRAPH`` words is looked up, in all documents that have the
   paragraph; a window that an earlier document has is removed too. So every stretch of ``PASSAGE``
   words or more that an earlier document has goes to its last word. Copies that stay are followed
   likewise, but for the parts of them that lie in a removed run of their document.

Defined cases: null and short texts (under ``PARAGRAPH`` words) have no paragraph; null doc_ids
count as larger than all others and are told apart by their texts; rows that agree in doc_id and
text are one document; repeats inside one document stay. Empty tables give empty results; other
columns are ignored (``remove_passages`` returns them all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from traitscope.llm.common import components, salted_join, trimmed, whole
from traitscope.llm.tokens import slices
from traitscope.session import discard, materialise

SHINGLE, PARAGRAPH, PASSAGE, SIMILARITY, RECALL, ROWS = 5, 16, 50, 0.8, 0.98, 2
BLOCK, FILTER_BITS = 2048, 27
#: Words from an end of a common passage to the nearest common paragraph, at most.
GAP = PASSAGE - PARAGRAPH
M64 = (1 << 64) - 1


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` minima that finds a pair of ``similarity`` with ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


BANDS = bands_for()
_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = _odd(256)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
IN_WORD, IN_SHINGLE, PERM, SHIFT, IN_BAND = _odd(PARAGRAPH), _odd(SHINGLE), _odd(BANDS * ROWS), _odd(BANDS * ROWS), _odd(ROWS)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = _power[base] = np.cumprod(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte, end and hash of every word of the concatenated texts."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _powers(BASE, len(data)), out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * _powers(INVERSE, len(data) + 1)[starts])
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, hashes


def anchors(docs: np.ndarray, shingles: np.ndarray, window: int) -> np.ndarray:
    """Positions of the anchors among start positions in document order; the upper 48 bits of the hashes decide."""
    if not len(docs):
        return np.empty(0, int)
    heads = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    sizes = np.diff(np.r_[heads, len(docs)])
    found = []
    if len(docs) >= window:
        for at in range(0, len(docs) - window + 1, 1 << 15):
            part = shingles[at : at + (1 << 15) + window - 1]
            # The least hash and, below it, its place in the part; of equal hashes the first.
            least, size = (part & ~np.uint64(0xFFFF)) | np.arange(len(part), dtype=np.uint64), 1
            while size < window:
                step = min(size, window - size)
                least, size = np.minimum(least[:-step], least[step:]), size + step
            ok = docs[at : at + len(least)] == docs[at + window - 1 : at + window - 1 + len(least)]
            places = (least[ok] & np.uint64(0xFFFF)).astype(np.int64) + at
            found.append(places[np.diff(places, prepend=-1) != 0])
    for head, size in zip(heads[sizes < window].tolist(), sizes[sizes < window].tolist()):
        found.append(np.array([head + int(shingles[head : head + size].argmin())]))
    picked = np.unique(np.concatenate(found))
    same = (picked > 0) & (shingles[picked] == shingles[picked - 1]) & (docs[picked] == docs[picked - 1])
    return picked[~same]  # of a run of one word only the first


def _anchored(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the paragraphs, and the shingle that begins at every word."""
    n = max(len(docs) - PARAGRAPH + 1, 0)
    count = max(len(docs) - SHINGLE + 1, 0)
    raw = np.zeros(count, np.uint64)
    for j in range(SHINGLE):
        raw += hashes[j : j + count] * IN_SHINGLE[j]
    shingles = _mix(raw)
    able = np.flatnonzero(docs[:n] == docs[PARAGRAPH - 1 : PARAGRAPH - 1 + n])
    return able[anchors(docs[able], shingles[able], GAP + 1)], shingles


def window_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the ``PARAGRAPH`` words from each place on."""
    total = np.zeros(len(at), np.uint64)
    for j in range(PARAGRAPH):
        total += hashes[at + j] * IN_WORD[j]
    return _mix(total).view(np.int64)


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Anchored paragraphs of concatenated texts with their hash, band keys and shingles."""
    docs, starts, ends, hashes = words_of(data, offsets)
    at, shingles = _anchored(docs, hashes)
    own = shingles[at[:, None] + np.arange(PARAGRAPH - SHINGLE + 1)]
    least = np.stack([(own * a + b).min(1) for a, b in zip(PERM, SHIFT)], 1) if len(at) else np.zeros((0, BANDS * ROWS), np.uint64)
    first = np.searchsorted(docs, docs[at], "left")
    keys = [
        _mix((least[:, ROWS * b : ROWS * (b + 1)] * IN_BAND).sum(1, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)
    ]
    return {
        "doc": docs[at],
        "hash": window_hashes(hashes, at),
        "word": (at - first).astype(np.int32),
        "start": starts[at] - offsets[docs[at]],
        "end": ends[at + PARAGRAPH - 1] - offsets[docs[at]],
        "keys": [k.view(np.int64) for k in keys],
        "shingles": np.sort((own >> np.uint64(32)).astype(np.uint32), 1),
    }


def text_rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of bounded runs of a batch's texts (column ``at``)."""
    column = batch.column(at).cast(pa.string())
    for a, b in slices(pc.binary_length(column).to_pylist(), 1 << 20):
        part = column.slice(a, b - a)
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield a, data, offsets - offsets[0]


def _band_keys(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (band, key, paragraph)."""
    for batch in source:
        for _, data, offsets in text_rows(batch, 0):
            p = paragraphs(data, offsets)
            n = len(p["hash"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(n, b == 0) for b in range(BANDS)])), pa.array(np.concatenate(p["keys"])), pa.array(np.tile(p["hash"], BANDS))],
                ["first", "bkey", "paragraph"],
            )


def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return _mix(keys.view(np.uint64) + np.uint64(77)) >> np.uint64(64 - bits)


def _key_bits(bits: int):
    """(bkey) -> (word of the bitmap, its bits)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = bit_of(batch.column(0).to_numpy(), bits)
            word = (at >> np.uint64(6)).astype(np.int64)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])

    return run


def bitmap(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of 2^bits cells of a table of keys: at most 2^(bits-6) words reach the driver."""
    words = keys.mapInArrow(trimmed(_key_bits(bits)), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def _met_again(shared, bits: int):
    """(doc_id, text_key, text) -> the paragraphs with a band key in the bitmap, a row for each such key."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in source:
            for a, data, offsets in text_rows(batch, 2):
                p = paragraphs(data, offsets)
                hit, keys = [], []
                for k in p["keys"]:
                    at = bit_of(k, bits)
                    on = np.flatnonzero(cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    hit.append(on)
                    keys.append(k[on])
                i = np.concatenate(hit)
                if not len(i):
                    continue
                rows = pa.array(p["doc"][i] + a)
                flat = np.ascontiguousarray(p["shingles"][i])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys)),
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(p["hash"][i]),
                        pa.array(p["word"][i]),
                        pa.array(p["start"][i]),
                        pa.array(p["end"][i]),
                        pa.array([x.tobytes() for x in flat], pa.binary()),
                    ],
                    ["bkey", "doc_id", "text_key", "paragraph", "word", "start", "end", "shingles"],
                )

    return run


def _hits(cells: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of the keys whose cell of the bitmap is set."""
    at = bit_of(keys, bits)
    return np.flatnonzero(cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))


def _beside(docs: np.ndarray, own: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``steps`` words from each of ``own`` with a whole window in its document, and whose they are."""
    first = np.searchsorted(docs, docs[own], "left")
    last = np.searchsorted(docs, docs[own], "right") - PARAGRAPH
    places = own[:, None] + steps
    ok = (places >= first[:, None]) & (places <= last[:, None])
    return places[ok], np.nonzero(ok)[0]


def _sides(cells: tuple, names: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of paragraphs that are an end on one side in some document, and the steps to that side."""
    for side, steps in zip(cells, (np.arange(-GAP, 0), np.arange(1, GAP + 1))):
        on = _hits(side, names, bits)
        for b in range(0, len(on), 1 << 12):
            yield on[b : b + (1 << 12)], steps


def _window_names(shared, bits: int):
    """(doc_id, text_key, text) -> (window, doc_id, document) of every window beside an end, once for each place."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = pc.fill_null(batch.column(0), -1).to_numpy().view(np.uint64)
            nulls = np.asarray(batch.column(0).is_null())
            document = _mix(_mix(ids + nulls) ^ batch.column(1).to_numpy().view(np.uint64)).view(np.int64)
            for a, data, offsets in text_rows(batch, 2):
                docs, _, _, hashes = words_of(data, offsets)
                at, _ = _anchored(docs, hashes)
                found = [_beside(docs, at[on], steps)[0] for on, steps in _sides(shared.value, window_hashes(hashes, at), bits)]
                if found:
                    flat = np.unique(np.concatenate(found))
                    rows = docs[flat] + a
                    columns = [pa.array(window_hashes(hashes, flat)), batch.column(0).take(pa.array(rows)), pa.array(document[rows])]
                    yield pa.RecordBatch.from_arrays(columns, ["window", "doc_id", "document"])

    return run


def _around(shared, bits: int):
    """(doc_id, text_key, text) -> for a document its windows in the bitmap up to ``GAP`` words beside the ends."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *cells, met = shared.value
        for batch in source:
            for a, data, offsets in text_rows(batch, 2):
                docs, starts, ends, hashes = words_of(data, offsets)
                at, _ = _anchored(docs, hashes)
                found = [_beside(docs, at[on], steps)[0] for on, steps in _sides(cells, window_hashes(hashes, at), bits)]
                flat = np.unique(np.concatenate(found)) if found else np.empty(0, int)
                window = window_hashes(hashes, flat)
                kept = _hits(met, window, bits)
                flat, window = flat[kept], window[kept]
                if not len(flat):
                    continue
                owner, heads = np.unique(docs[flat], return_index=True)
                cuts = pa.array(np.r_[heads, len(flat)].astype(np.int32))
                base = offsets[docs[flat]]
                fields = [
                    pa.array(window),
                    pa.array((flat - np.searchsorted(docs, docs[flat], "left")).astype(np.int32)),
                    pa.array((starts[flat] - base).astype(np.int32)),
                    pa.array((ends[flat + PARAGRAPH - 1] - base).astype(np.int32)),
                ]
                rows = pa.array(owner + a)
                lists = [pa.ListArray.from_arrays(cuts, field) for field in fields]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *lists], ["doc_id", "text_key", "window", "word", "start", "end"])

    return run


def _wanted(outside: bool):
    """(doc_id, text_key, window, word, start, end, near_, gone_, stays_), lists, a row for a document -> its windows that matter."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fields = [batch.column(i).flatten() for i in range(2, 6)]
            rows = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(2)).to_numpy())
            places = (rows << 32) + fields[1].to_numpy()
            near, gone, stays = (_inside(places, batch.column(i)) for i in (6, 7, 8))
            at = np.flatnonzero(near & ~gone if outside else near)
            own = pa.array(rows[at])
            columns = [batch.column(0).take(own), batch.column(1).take(own), *(f.take(pa.array(at)) for f in fields), pa.array(stays[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "window", "word", "start", "end", "stays"])

    return run


def _inside(places: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Whether places (row and word) lie in one of the spans (from, until) of their row."""
    rows = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).to_numpy())
    first, last = (spans.flatten().field(k).to_numpy() for k in (0, 1))
    some = (first <= last) & (last >= 0)
    first, last = (np.sort((rows[some] << 32) + np.maximum(x[some], 0)) for x in (first, last))
    return np.searchsorted(first, places, "right") > np.searchsorted(last, places, "left")


WANTED = "doc_id long, text_key long, window long, word int, start int, end int, stays boolean"


def _stretches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text_key, removed, word, start, end, keep, window) -> stretches of windows that touch."""
    rest = None
    for batch in source:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            heads = _stretch_heads(table)
            # The last stretch may go on in the next batch.
            rest = table.slice(heads[-1])
            yield from _as_stretches(table.slice(0, heads[-1]), heads[:-1])
    if rest is not None:
        yield from _as_stretches(rest, np.zeros(1, np.int64))


def _stretch_heads(table: pa.Table) -> np.ndarray:
    ids, texts, removed, word = (pc.fill_null(table[c], fill).to_numpy() for c, fill in (("doc_id", 0), ("text_key", 0), ("removed", False), ("word", 0)))
    null = table["doc_id"].is_null().to_numpy()
    other = np.zeros(len(word), bool)
    other[:1] = True
    for x in (ids, null, texts, removed):
        other[1:] |= x[1:] != x[:-1]
    other[1:] |= word[1:].astype(np.int64) - word[:-1] > PARAGRAPH
    return np.flatnonzero(other)


def _as_stretches(table: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(heads):
        return
    n = len(table)
    group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))
    word, start, end, window = (table[c].to_numpy() for c in ("word", "start", "end", "window"))
    null = table["keep"].is_null().to_numpy()
    keep = pc.fill_null(table["keep"], np.iinfo(np.int64).max).to_numpy()

    def distinct(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        blank = np.zeros(n, bool) if mask is None else mask
        order = np.lexsort((values, blank, group))
        g, v, b = group[order], values[order], blank[order]
        fresh = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (b[1:] != b[:-1])])
        cuts = np.searchsorted(g[fresh], np.arange(len(heads) + 1)).astype(np.int32)
        items = pa.array(v[fresh], mask=None if mask is None else b[fresh])
        return pa.ListArray.from_arrays(pa.array(cuts), items if mask is None else pc.fill_null(items.cast(pa.string()), "null"))

    first = table.select(["doc_id", "text_key", "removed"]).take(pa.array(heads)).combine_chunks()
    columns = [
        *(first[c].combine_chunks() for c in first.column_names),
        pa.array(word[heads]),
        pa.array((np.maximum.reduceat(word, heads) + PARAGRAPH).astype(np.int32)),
        pa.array(np.minimum.reduceat(start, heads).astype(np.int64)),
        pa.array(np.maximum.reduceat(end, heads).astype(np.int64)),
        pa.array(np.minimum.reduceat(keep, heads), mask=np.logical_and.reduceat(null, heads)),
        distinct(keep, null),
        pa.array(np.minimum.reduceat(window, heads)),
        distinct(window),
    ]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in STRETCH.split(", ")])


STRETCH = (
    "doc_id long, text_key long, removed boolean, word int, until int, start long, end long, keep long, keeps array<string>, cluster long, clusters array<long>"
)
AROUND = "doc_id long, text_key long, window array<long>, word array<int>, start array<int>, end array<int>"
MEMBER = "bkey long, doc_id long, text_key long, paragraph long, word int, start long, end long, shingles binary"
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def similar(sets: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Root of every row among the links of rows whose sets (sorted hashes) are similar enough."""
    n = len(sets)
    root = np.arange(n)
    parts = [np.unique(s) for s in sets]
    ids, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    size = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(inverse, kind="stable")
    lists = np.split(owner[order], np.cumsum(np.bincount(inverse, minlength=len(ids)))[:-1])
    at = np.cumsum(size) - size
    for i in range(n):
        common = np.bincount(np.concatenate([lists[k] for k in inverse[at[i] : at[i] + size[i]]]), minlength=n)
        close = np.flatnonzero(common >= similarity * (size + size[i] - common) - 1e-9)
        roots = root[close]
        least = roots.min()
        if (roots != least).any():
            root[np.isin(root, roots)] = least
    return root


def _verify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (bkey, bi, bj, paragraph, shingles) -> links between the similar ones of a group.

    Groups of a few paragraphs are compared all at once, larger ones in turn.
    """
    width = PARAGRAPH - SHINGLE + 1
    keys, names, sets = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint32)
    for batch in source:
        if not batch.num_rows:
            continue
        part = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        data = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint32).reshape(-1, width)
        keys, names, sets = np.concatenate([keys, part]), np.concatenate([names, batch.column(3).to_numpy()]), np.concatenate([sets, data])
        heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        end = int(heads[-1])  # the last group may go on in the next batch
        if end:
            yield _links(heads, names[:end], sets[:end])
            keys, names, sets = keys[end:], names[end:], sets[end:]
    if len(keys):
        yield _links(np.array([0, len(keys)]), names, sets)


def _links(heads: np.ndarray, names: np.ndarray, sets: np.ndarray, few: int = 5) -> pa.RecordBatch:
    """Links of similar paragraphs in groups that begin at ``heads``, the last of which is the end."""
    sizes = np.diff(heads)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    small = sizes <= few
    for apart in range(1, few):
        i = np.flatnonzero((group[:-apart] == group[apart:]) & small[group[apart:]])
        for at in range(0, len(i), 1 << 15):
            x = i[at : at + (1 << 15)]
            ok = jaccard(sets[x], sets[x + apart]) >= SIMILARITY - 1e-9
            found.append((names[x[ok]], names[x[ok] + apart]))
    for g in np.flatnonzero(~small).tolist():
        own = slice(heads[g], heads[g + 1])
        root = similar(sets[own])
        at = np.flatnonzero(root != np.arange(len(root)))
        found.append((names[own][at], names[own][root[at]]))
    sides = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sides], schema=EDGE)


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the sets in the rows of two tables of sorted hashes; repeats in a row count once."""
    fresh = [np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], 1) for x in (a, b)]
    common = ((a[:, :, None] == b[:, None, :]).any(2) & fresh[0]).sum(1)
    return common / (fresh[0].sum(1) + fresh[1].sum(1) - common)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_passages(docs: DataFrame, block: int = BLOCK, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that repeat across documents, one row for each and its document.

    doc_id, text_key, first_word, n_words, start, end (bytes of the text), keep_doc_id (document of
    the copy that stays), cluster_id, removed (false for the copies that stay), keep_doc_ids and
    cluster_ids (all of a merged run, apart by commas; keep_doc_id and cluster_id are the least). A
    stretch without a removed paragraph of its own has its windows' hashes as clusters.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(whole()).alias("text_key"), whole().alias("text"))
    keys = docs.select("text").mapInArrow(trimmed(_band_keys), "first boolean, bkey long, paragraph long")
    met = keys.groupBy("bkey").agg(
        F.count("*").alias("n"), F.min("paragraph").alias("low"), F.max("paragraph").alias("high"), F.max("first").alias("first")
    )
    # Equal paragraphs meet in every band; the first one names them. Other bands matter for different ones.
    met = materialise(
        met.where("n > 1 and (first or low <> high)").select("bkey", (F.col("low") != F.col("high")).alias("differ")), "passage-keys"
    )
    shared = spark.sparkContext.broadcast(bitmap(met.select("bkey"), filter_bits))
    found = docs.mapInArrow(trimmed(_met_again(shared, filter_bits)), MEMBER)
    found = salted_join(found, met, ["bkey"], F.xxhash64("paragraph", "word"), salts=4, written=True, hint="shuffle_hash")
    found = materialise(found, "passage-members")
    # Every machine has a file of a bitmap until it is destroyed.
    shared.destroy()
    discard(met)
    classes = found.where("differ").select("bkey", "paragraph", "shingles").distinct()
    sizes = classes.groupBy("bkey").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = salted_join(classes, sizes, ["bkey"], F.col("paragraph"), salts=4)
    own = F.pmod(F.xxhash64("paragraph", F.lit(1)), F.col("blocks")).cast("int")
    dealt = dealt.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bkey", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "paragraph", "shingles")
    links = dealt.repartition("bkey", "bi", "bj").sortWithinPartitions("bkey", "bi", "bj").mapInArrow(trimmed(_verify), "a long, b long")
    roots = materialise(components(links.distinct(), "passage-links").withColumnRenamed("node", "paragraph"), "passage-roots")
    place = ["doc_id", "text_key", "word", "start", "end"]
    members = found.select(*place, "paragraph").distinct()
    members = salted_join(members, roots, ["paragraph"], F.xxhash64("word", "text_key"), salts=4, how="left", written=True)
    members = materialise(members.select(*place, "paragraph", F.coalesce("root", "paragraph").alias("cluster_id")), "passage-clusters")
    discard(found)
    discard(roots)
    marked = materialise(_runs(_headed(members, "cluster_id", "passage-heads")), "passage-marked")
    discard(members)
    return _merged(marked, _end_windows(docs, marked, filter_bits))


def _end_windows(docs: DataFrame, marked: DataFrame, filter_bits: int) -> DataFrame:
    """A written table of the windows beside the ends of runs that several documents have, as stretches of those that touch.

    Windows in a removed run of their document, or in a run that stays if they stay, add nothing and
    are left out. Most windows beside an end are met once, and most of the others lie in a removed run. So their
    names are counted first, with the least id of each, and a second reading of the texts gives
    places to those met again, a row for a document; joins on the document and on the name then
    decide exactly.
    """
    context = docs.sparkSession.sparkContext
    ends = materialise(_ends(marked), "passage-ends")
    sides = tuple(bitmap(ends.where(f"{side} is not null").select("paragraph"), filter_bits) for side in ("left", "right"))
    first = context.broadcast(sides)
    names = docs.mapInArrow(trimmed(_window_names(first, filter_bits)), "window long, doc_id long, document long")
    met = names.groupBy("window").agg(F.min("doc_id").alias("least"), F.min("document").alias("low"), F.max("document").alias("high"))
    met = materialise(met.where("low <> high").select("window", "least"), "passage-window-names")
    first.destroy()
    shared = context.broadcast((*sides, bitmap(met.select("window"), filter_bits)))
    found = docs.mapInArrow(trimmed(_around(shared, filter_bits)), AROUND)
    # Where a document's windows may begin, and where its runs make them needless. All its end
    # paragraphs are marked, so this is exact whatever the bitmaps let through.
    near = salted_join(marked.select("doc_id", "text_key", "paragraph", "word").distinct(), ends, ["paragraph"], F.xxhash64("word", "text_key"), salts=4, written=True)
    reach = [F.struct((F.col("word") + low).alias("col1"), (F.col("word") + high).alias("col2")) for low, high in ((F.lit(-GAP), -F.col("left")), (F.col("right"), F.lit(GAP)))]
    near = near.select("doc_id", "text_key", F.inline(F.array(*[F.struct(F.lit("near").alias("kind"), x["col1"].alias("from"), x["col2"].alias("until")) for x in reach])))
    runs = marked.groupBy("doc_id", "text_key", "removed", "run").agg(F.min("word").alias("from"), F.max("word").alias("until"))
    runs = runs.select("doc_id", "text_key", F.when(F.col("removed"), "gone").otherwise("stays").alias("kind"), "from", "until")
    spans = near.where("until is not null and from is not null").unionByName(runs).groupBy("doc_id", "text_key").agg(
        *[F.collect_set(F.when(F.col("kind") == k, F.struct("from", "until"))).alias(f"{k}_") for k in ("near", "gone", "stays")]
    )
    spans = materialise(spans, "passage-spans-of-documents")

    def beside(rows: DataFrame, outside: bool) -> DataFrame:
        rows = salted_join(rows, spans, ["doc_id", "text_key"], F.col("text_key"), salts=1, written=True)
        return rows.select("doc_id", "text_key", "window", "word", "start", "end", "near_", "gone_", "stays_").mapInArrow(trimmed(_wanted(outside)), WANTED)

    headed = salted_join(beside(found, True), met, ["window"], F.xxhash64("word", "text_key"), salts=4, written=True, hint="shuffle_hash")
    removed = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    again = materialise(marked.select("doc_id", "text_key").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), "passage-ids")
    if again.count():
        # Documents of one id, or without any: the lesser text is the earlier one.
        tied = beside(salted_join(found, again, ["doc_id"], F.col("text_key"), salts=4, written=True), False)
        ties = materialise(tied.groupBy("window", "doc_id").agg(F.min("text_key").alias("first")), "passage-ties")
        headed = salted_join(headed, ties, ["window", "doc_id"], F.xxhash64("word", "text_key"), salts=4, how="left", written=True)
        removed = removed | F.coalesce(F.col("text_key") != F.col("first"), F.lit(False))
    windows = headed.where(removed | ~F.col("stays")).select("doc_id", "text_key", removed.alias("removed"), "word", "start", "end", F.col("least").alias("keep"), "window")
    windows = windows.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "removed", "word")
    windows = materialise(windows.mapInArrow(trimmed(_stretches), STRETCH), "passage-windows")
    shared.destroy()
    for table in (ends, met, spans, again):
        discard(table)
    return windows


def _headed(members: DataFrame, name: str, label: str) -> DataFrame:
    """The rows whose ``name`` several documents have, with its first place (head), and whether they are removed."""
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key", "word")
    document = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    heads = members.groupBy(name).agg(F.min(order).alias("head"), F.max(document).alias("last"))
    heads = heads.where(~F.struct("head.z", "head.doc_id", "head.text_key").eqNullSafe(F.struct("last.z", "last.doc_id", "last.text_key")))
    heads = materialise(heads.select(name, "head"), label)
    headed = salted_join(members, heads, [name], F.xxhash64("word", "text_key"), written=True)
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return headed.withColumn("removed", ~stays)


def _runs(marked: DataFrame) -> DataFrame:
    """Number the runs of a document's paragraphs that touch, or continue each other on one diagonal."""
    line = F.xxhash64("head.doc_id", "head.text_key", F.col("word") - F.col("head.word"))
    by = Window.partitionBy("doc_id", "text_key", "removed").orderBy("word", "cluster_id")
    apart = F.col("word") - F.lag("word").over(by)
    goes_on = (apart <= PARAGRAPH) | ((F.col("line") == F.lag("line").over(by)) & (apart <= PASSAGE))
    step = marked.withColumn("line", line).withColumn("new", F.when(goes_on, 0).otherwise(1))
    return step.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("line", "new")


def _ends(marked: DataFrame) -> DataFrame:
    """Paragraphs removed near an end of a run, and how far before (left) or after (right) them its outside begins.

    Not the outermost alone: that one may be no anchor in the document with the longer common stretch.
    """
    run = Window.partitionBy("doc_id", "text_key", "removed", "run")
    left = F.col("word") - F.min("word").over(run) + 1
    right = F.max("word").over(run) - F.col("word") + 1
    near = marked.where("removed").select("paragraph", left.alias("left"), right.alias("right"))
    # Windows touch the paragraph, which may be the outermost one in the other document.
    touch = [F.when(F.col(c) <= GAP + 1, F.least(c, F.lit(PARAGRAPH))).alias(c) for c in ("left", "right")]
    near = near.select("paragraph", *touch)
    return near.where("left is not null or right is not null").groupBy("paragraph").agg(F.min("left").alias("left"), F.min("right").alias("right"))


def _merged(marked: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs and stretches of windows of a document that touch, as one passage."""
    place = ["doc_id", "text_key", "removed"]
    keeps = F.collect_set(F.coalesce(F.col("head.doc_id").cast("string"), F.lit("null"))).alias("keeps")
    spans = [F.min("word").alias("word"), (F.max("word") + PARAGRAPH).alias("until"), F.min("start").alias("start"), F.max("end").alias("end")]
    least = F.min("head.doc_id").alias("keep")
    runs = marked.groupBy(*place, "run").agg(*spans, least, keeps, F.min("cluster_id").alias("cluster"), F.collect_set("cluster_id").alias("clusters"))
    more = windows.withColumn("_window", F.lit(True))
    by = Window.partitionBy(*place).orderBy("word", "until")
    before = F.max("until").over(by.rowsBetween(Window.unboundedPreceding, -1))
    step = runs.drop("run").withColumn("_window", F.lit(False)).unionByName(more).withColumn("new", F.when(F.col("word") <= before, 0).otherwise(1))
    step = step.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    every = lambda lists: F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))).cast("array<string>"))
    # Windows have ids of their own only where they touch no paragraph.
    step = step.withColumn("alone", F.min("_window").over(Window.partitionBy(*place, "run")))
    own = ~F.col("_window") | F.col("alone")
    return step.groupBy(*place, "run").agg(
        F.min("word").alias("first_word"),
        (F.max("until") - F.min("word")).alias("n_words"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("keep").alias("keep_doc_id"),
        F.min(F.when(own, F.col("cluster"))).alias("cluster_id"),
        every("keeps").alias("keep_doc_ids"),
        every(F.when(own, F.col("clusters"))).alias("cluster_ids"),
    ).select("doc_id", "text_key", "first_word", "n_words", "start", "end", "keep_doc_id", "cluster_id", "removed", "keep_doc_ids", "cluster_ids")


@F.arrow_udf(StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        data, at, kept = text.encode(), 0, []
        for c in sorted(cuts, key=lambda c: (c["start"], c["end"])):
            if c["start"] > at:
                kept.append(data[at : c["start"]])
            at = max(at, c["end"])
        kept.append(data[at:])
        out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def remove_passages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without removed passages; texts left without a word go.

    ``n_chars``, where there is such a column, follows the text.
    """
    names = docs.columns
    spans = repeated_passages(docs).where("removed")
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    spans = materialise(spans.withColumnsRenamed({"doc_id": "_k", "text_key": "_t"}), "passage-spans")
    keyed = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_id"), whole().alias("_text"))
    match = F.col("_id").eqNullSafe(F.col("_k")) & (text_key(F.col("_text")) == F.col("_t"))
    joined = keyed.join(spans, match, "left")
    cut = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(
        _without("_text", F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    )
    joined = joined.select("_row", "_spans", cut.alias("_new"))
    joined = joined.where(F.col("_spans").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")) if "n_chars" in names else None}
    types = dict(docs.dtypes)
    return joined.select(*[(new[c] if new.get(c) is not None else F.col("_row")[c]).cast(types[c]).alias(c) for c in names])
