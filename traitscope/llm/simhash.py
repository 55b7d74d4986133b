"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has the majority bit of the XXH64 hashes of its 3-word shingles, repeats
included. Fingerprints within ``RADIUS`` bits are linked; a document's component_id is the smallest
doc_id that links reach.

Distinct fingerprints only are compared. Two of them within 2 bits agree in two of four 16-bit
quarters at least, so each goes into six buckets of a 32-bit key. Buckets are compared in blocks:
bit plane j of a block holds bit j of all its fingerprints, one lane each, and the distances of a
query to all lanes are counted at once by carry-save counters over the planes, until every lane of
the block is beyond the radius. A bucket larger than a block becomes pairs of blocks, so no task
holds it whole; a block yields at most one link per lane, not all pairs.

Defined cases: a null or empty text has no word and the fingerprint zero, linked like any other;
with 1 or 2 words the whole sequence is one shingle. Null doc_ids count as larger than all others (a
component of nulls alone has a null id). Repeated rows are returned one by one. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from traitscope.llm.common import LOWER_BYTES, components, salted_join, trimmed, whole
from traitscope.session import materialise

RADIUS, SHINGLE, BLOCK = 2, 3, 4096


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of every n-word shingle of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) <= n:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint as a signed long."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([majority(shingle_hashes(t.as_buffer().to_pybytes())) for t in column.cast(pa.string())], pa.int64())


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes; lane i is bit i % 64 of word i // 64."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -len(fps) % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def beyond(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS, own: np.ndarray | None = None, lanes: int | None = None, left: list | None = None) -> np.ndarray:
    """Lanes (queries x words) whose distance to the query exceeds the radius.

    Counters start so that the carry out of their highest bit says "beyond"; a query abandons the
    block once that holds for all lanes. ``own`` is the lane of each query where it stands in the
    block itself, and lanes from ``lanes`` on are padding: both count as beyond on the way, so that
    they do not hold the block open, and are cleared at the end (own lanes are at distance 0). The
    number of queries that abandoned the block is appended to ``left``.
    """
    width = (radius + 1).bit_length()
    start = (1 << width) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    shape = (len(queries), planes.shape[1])
    counter = [np.full(shape, full if start >> b & 1 else np.uint64(0)) for b in range(width)]
    skipped = np.zeros(shape, np.uint64)
    lanes = 64 * planes.shape[1] if lanes is None else lanes
    if lanes % 64:
        skipped[:, lanes // 64] = full << np.uint64(lanes % 64)
    if own is not None:
        at = np.arange(len(queries))
        skipped[at, own // 64] |= np.uint64(1) << (own % 64).astype(np.uint64)
    over, out = skipped.copy(), np.empty_like(skipped)
    live = np.arange(len(queries))
    for j in range(64):
        ones = (queries[live] >> np.uint64(j) & np.uint64(1)) * full
        carry = planes[j][None, :] ^ ones[:, None]
        for b in range(width):
            counter[b], carry = counter[b] ^ carry, counter[b] & carry
        over |= carry
        if j % 8 == 7 and j < 63:
            done = (over == full).all(1)
            if done.any():
                out[live] = over
                live = live[~done]
                if not len(live):
                    break
                over = over[~done]
                counter = [c[~done] for c in counter]
    if len(live):
        out[live] = over
    if left is not None:
        left.append(len(queries) - len(live))
    return out & ~skipped


def block_links(fps: np.ndarray, radius: int = RADIUS, batch: int = 128) -> np.ndarray:
    """For every lane the first lane of its component among the links inside the block."""
    n = len(fps)
    planes, root = planes_of(fps), np.arange(n)
    for at in range(0, n, batch):
        queries = fps[at : at + batch]
        near = ~beyond(planes, queries, radius, np.arange(at, at + len(queries)), n)
        hits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
        for i in np.flatnonzero(hits.sum(1) > 1):
            roots = root[np.flatnonzero(hits[i])]
            least = roots.min()
            if (roots != least).any():
                root[np.isin(root, roots)] = least
    return root


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(most: int):
    """Sorted rows (which, key, bi, bj, fp) -> links; whole groups share blocks of up to ``most`` lanes."""

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.unique(np.concatenate(parts))
        root = block_links(fps)
        at = np.flatnonzero(root != np.arange(len(fps)))
        pairs = (fps[at].view(np.int64), fps[root[at]].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], schema=EDGE)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, group, held, size = None, [], [], 0
        for batch in source:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            fps = batch.column(4).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a])
                if key != open_key:
                    if group:
                        n = sum(map(len, group))
                        if held and size + n > most:
                            yield links(held)
                            held, size = [], 0
                        held, size = held + group, size + n
                    open_key, group = key, []
                group.append(fps[a:b].copy())
        held = held + group
        if held:
            yield links(held)

    return run


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within the radius."""
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [
        F.struct(F.lit(w).alias("which"), F.shiftleft(quarter[i], 16).bitwiseOR(quarter[j]).alias("key"))
        for w, (i, j) in enumerate(itertools.combinations(range(4), 2))
    ]
    rows = fps.select("fp", F.inline(F.array(*keys)))
    sizes = rows.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "simhash-buckets")
    dealt = salted_join(rows, sizes, ["which", "key"], F.col("fp"), salts=4, written=True)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = dealt.select("which", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "which", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "fp"
    ).repartition("which", "key", "bi", "bj")
    return dealt.sortWithinPartitions("which", "key", "bi", "bj").mapInArrow(trimmed(_compare(2 * block)), "a long, b long").distinct()


def component_of(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp -> component_id for a written table of (doc_id, fp)."""
    fps = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = components(links(fps.select("fp"), block), "simhash-links")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return salted_join(named.select("fp", "root"), least, ["root"], F.col("fp")).select("fp", "component_id")


def simhash_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text)."""
    marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprints(whole()).alias("fp"))
    marks = materialise(marks, "simhash-marks")
    out = salted_join(marks, component_of(marks, block), ["fp"], F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
