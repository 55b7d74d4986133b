"""Best-fit packing of token sequences by linear grouping.

Documents become ids; only documents longer than a sequence are cut, into full pieces with the
shorter piece first. Full pieces are sequences of their own. The other pieces are dealt at random
over shards of a bounded number of pieces, and each shard is packed on its own:

1. large lengths are rounded up to the longest of groups of equal cardinality;
2. the few sizes are packed by configurations: column generation, with a knapsack over the
   capacity that prices patterns, solves the linear program, and whole patterns are taken;
3. the documents of a group replace its rounded size, longest first;
4. sequences that the rounding left with a gap are opened again, and their pieces, those left
   over and the small ones are placed best-fit, in order of decreasing length.

Defined cases: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are
packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import trimmed, whole
from traitscope.llm.tokens import encoder, slices
from traitscope.session import materialise

GROUPS, SMALL, GAP, SHARD = 96, 8, 2, 100_000


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use them, to cover ``demand`` of ``sizes``: an LP optimum."""
    n = len(sizes)
    fit = (capacity // sizes).astype(float)
    columns, inverse, use = np.diag(fit), np.diag(1 / fit), demand / fit
    cost = np.ones(n)
    for _ in range(steps):
        price = cost @ inverse
        worst = int(np.argmin(price))
        if price[worst] < -1e-9:
            entering, own = -np.eye(n)[worst], 0.0
        else:
            entering, own = _knapsack(sizes, price, capacity), 1.0
            if price @ entering <= 1 + 1e-7:
                break
        step = inverse @ entering
        able = np.flatnonzero(step > 1e-9)
        ratio = use[able] / step[able]
        out = int(able[np.argmin(ratio)])
        use = use - ratio.min() * step
        use[out] = ratio.min()
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
        columns[:, out], cost[out] = entering, own
    real = cost > 0
    return columns[:, real].astype(int), np.maximum(use[real], 0)


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes within the capacity."""
    able = np.flatnonzero(price > 1e-12)
    s, v = sizes[able], price[able]
    rest = np.arange(capacity + 1)[None, :] - s[:, None]
    outside = rest < 0
    rest = np.maximum(rest, 0)
    best, taken = np.zeros(capacity + 1), []
    while True:
        gain = best[rest] + v[:, None]
        gain[outside] = -1
        which = gain.argmax(0)
        top = gain[which, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        taken.append(np.where(better, which, -1))
        best = np.where(better, top, best)
    out, left = np.zeros(len(sizes)), capacity
    for choice in reversed(taken):
        if choice[left] >= 0:
            out[able[choice[left]]] += 1
            left -= s[choice[left]]
    return out


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put the items ``order`` where the least room is left; opens bins as needed."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(free):
        if f:
            room[f].append(b)
            mask |= 1 << f
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        at = mask >> size
        if at:
            f = size + (at & -at).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                mask ^= 1 << f
        else:
            f, b = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(item)
        free[b] = f - size
        if f > size:
            room[f - size].append(b)
            mask |= 1 << (f - size)


def pack_lengths(lengths: np.ndarray, capacity: int, groups: int = GROUPS, small: int = SMALL, gap: int = GAP) -> list[list[int]]:
    """Items of each sequence. ``lengths`` are from 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] * small > capacity]
    bins: list[list[int]] = []
    placed = np.zeros(len(lengths), bool)
    if len(large) >= 4 * groups:
        parts = np.array_split(large, groups)
        rounded = np.array([lengths[p[0]] for p in parts])
        sizes, group = np.unique(rounded, return_inverse=True)
        queues = [np.concatenate([p for p, g in zip(parts, group) if g == i]) for i in range(len(sizes))]
        columns, use = patterns(sizes, np.array([len(q) for q in queues], float), capacity)
        taken = [0] * len(sizes)
        for column, times in zip(columns.T, np.floor(use + 1e-6).astype(int).tolist()):
            kinds = [int(i) for i in np.repeat(np.arange(len(sizes)), column)]
            times = min([times, *[(len(queues[i]) - taken[i]) // column[i] for i in set(kinds)]])
            if times <= 0 or not kinds:
                continue
            slots = []
            for i in kinds:
                slots.append(queues[i][taken[i] : taken[i] + times])
                taken[i] += times
            table = np.stack(slots, 1)
            tight = table[capacity - lengths[table].sum(1) <= gap]
            bins.extend(tight.tolist())
            placed[tight.ravel()] = True
    free = [capacity - int(lengths[b].sum()) for b in bins]
    best_fit(lengths, order[~placed[order]], bins, free, capacity)
    return bins


def _tokenize(path: str, end: int, capacity: int, keep: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in source:
            texts = batch.column(2)
            sizes = pc.binary_length(texts).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                ids = [x + tail for x in encode.ids(part.column(2).to_pylist())]
                counts = [len(x) // 4 for x in ids]
                crcs = []
                for x, n in zip(ids, counts):
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    view = memoryview(x)
                    crcs.append([zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(cuts[:-1], cuts[1:])])
                columns = [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                names = ["uid", "doc_id", "n", "crcs"]
                if keep:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pack_shard(capacity: int, keep: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        n = table["n"].to_numpy()
        first = (n - 1) % capacity + 1
        pieces = (n + capacity - 1) // capacity
        doc = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, first[doc])
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        full = length == capacity
        sequence[full] = np.arange(full.sum())
        rest = np.flatnonzero(~full)
        bins = pack_lengths(length[rest], capacity)
        members = np.array([i for b in bins for i in b], np.int64)
        sizes = np.array([len(b) for b in bins], np.int64)
        at = rest[members]
        sequence[at] = full.sum() + np.repeat(np.arange(len(bins)), sizes)
        before = np.cumsum(length[at]) - length[at]
        heads = np.cumsum(sizes) - sizes
        offset[at] = before - np.repeat(before[heads] if len(bins) else before, sizes)
        out = {
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(doc)) if len(n) else table["doc_id"],
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pc.list_flatten(table["crcs"]),
            "sequence_id": pa.array((key[0].as_py() << 40) + sequence, pa.int64()),
            "offset": pa.array(offset, pa.int64()),
        }
        if keep:
            ids = table["ids"].to_pylist()
            spans = zip(doc.tolist(), start.tolist(), length.tolist())
            out["ids"] = pa.array([np.frombuffer(ids[d], "<u4")[s : s + k].astype(np.int32) for d, s, k in spans], pa.list_(pa.int32()))
        return pa.table(out)

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, shard: int = SHARD, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``vocabulary`` is a tokenizer file that every executor can open; ``shard`` bounds the documents
    that are packed together in one task.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    schema = "uid long, doc_id long, n long, crcs array<long>" + (", ids binary" if keep_ids else "")
    counted = materialise(rows.mapInArrow(trimmed(_tokenize(vocabulary, end, capacity, keep_ids)), schema), "pack-tokens")
    shards = max(1, -(-counted.count() // shard))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return (
        counted.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("long"))
        .groupBy("shard")
        .applyInArrow(_pack_shard(capacity, keep_ids), fields + (", ids array<int>" if keep_ids else ""))
    )
