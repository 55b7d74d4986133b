"""One document of each group of near copies, by SimHash and exact Jaccard similarity.

Two texts are linked if their fingerprints differ in ``simhash.RADIUS`` bits at most, or if their
sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Fingerprints of such sets are up
to 20 bits apart, too far for buckets of equal bits, so candidates of the second kind meet in
MinHash bands over the shingles. Inside a block of a bucket the bit-sliced comparison with the wide
radius leaves few pairs, and the exact similarity decides. A bucket larger than a block becomes
pairs of blocks; texts already linked in a block are not compared again, and a block yields at most
one link per text. Only texts of buckets with different texts give their sets to a shuffle.

Defined cases: null and empty texts are equal texts; of a component the row with the smallest
doc_id stays (null ids last, then the smallest digest); rows that agree in doc_id and text leave one
row; texts of fewer than 5 words have one shingle, the whole. Empty tables give empty tables; all
columns are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import components, rows_of, salted_join, trimmed, whole
from traitscope.llm.simhash import EDGE, beyond, links, majority, planes_of, shingle_hashes
from traitscope.llm.substring_dedup import FILTER_BITS, IN_SHINGLE, SHINGLE, _mix, _odd, bands_for, bit_of, bitmap, text_rows, words_of
from traitscope.session import materialise

ROWS, SIMILARITY, WIDE, BLOCK = 3, 0.8, 20, 1024
BANDS = bands_for(SIMILARITY, 0.98, ROWS)
PERM, SHIFT, IN_BAND = _odd(BANDS * ROWS), _odd(BANDS * ROWS), _odd(ROWS)


def shingles_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every 5-word shingle; a shorter text has its words as one shingle."""
    docs, _, _, hashes = words_of(data, offsets)
    n = max(len(docs) - SHINGLE + 1, 0)
    raw = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        raw += hashes[j : j + n] * IN_SHINGLE[j]
    ok = docs[:n] == docs[SHINGLE - 1 : SHINGLE - 1 + n]
    owner, value = docs[:n][ok], _mix(raw[ok])
    sizes = np.bincount(docs, minlength=len(offsets) - 1)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        firsts = np.searchsorted(docs, short)
        rest = np.array([_mix((hashes[a : a + sizes[d]] * IN_SHINGLE[: sizes[d]]).sum(dtype=np.uint64, keepdims=True))[0] for a, d in zip(firsts, short)], np.uint64)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, rest])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    return owner, value


def _mark(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text_sha256, text) -> the same without text, with fingerprint and band keys."""
    for batch in source:
        for a, data, offsets in text_rows(batch, 3):
            n = len(offsets) - 1
            owner, value = shingles_of(data, offsets)
            least = np.zeros((n, BANDS * ROWS), np.uint64)
            if len(owner):
                heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                least[owner[heads]] = np.stack([np.minimum.reduceat(value * p + s, heads) for p, s in zip(PERM, SHIFT)], 1)
            keys = np.stack([_mix((least[:, ROWS * b : ROWS * (b + 1)] * IN_BAND).sum(1, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)], 1)
            fps = [majority(shingle_hashes(data[x:y].tobytes())) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            rows = batch.slice(a, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(fps, pa.int64()), lists], ["doc_id", "text_key", "text_sha256", "fp", "keys"])


def _sets(shared, bits: int):
    """(text_key, text) -> (text_key, sorted shingle hashes) of the texts in the bitmap."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in source:
            at = bit_of(batch.column(0).to_numpy(), bits)
            on = np.flatnonzero(cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            if not len(on):
                continue
            kept = pa.RecordBatch.from_arrays([c.take(pa.array(on)) for c in batch.columns], batch.schema.names)
            for a, data, offsets in text_rows(kept, 1):
                owner, value = shingles_of(data, offsets)
                n = len(offsets) - 1
                cuts = np.searchsorted(owner, np.arange(n + 1))
                sets = [np.unique(value[x:y]).tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(a, n), pa.array(sets, pa.binary())], ["text_key", "shingles"])

    return run


def similar_texts(fps: np.ndarray, sets: list[np.ndarray], similarity: float, wide: int = WIDE) -> np.ndarray:
    """Root of every text among the links of similar texts whose fingerprints are near enough."""
    n = len(fps)
    root = np.arange(n)
    planes = planes_of(fps)
    for at in range(0, n, 128):
        queries = fps[at : at + 128]
        near = ~beyond(planes, queries, wide, np.arange(at, at + len(queries)), n)
        hits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
        for i, row in enumerate(hits, at):
            for j in np.flatnonzero(row[:i]).tolist():
                if root[i] == root[j]:
                    continue
                a, b = sets[i], sets[j]
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    continue
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= similarity * (len(a) + len(b) - common) - 1e-9:
                    x, y = sorted((root[i], root[j]))
                    root[root == y] = x
    return root


def _verify(similarity: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (key, bi, bj, text_key, fp, shingles) -> links between the similar texts of a group."""
        open_key, held = None, {}

        def found() -> pa.RecordBatch:
            names = sorted(held)
            sets = [np.frombuffer(held[k][1], np.uint64) for k in names]
            root = similar_texts(np.array([held[k][0] for k in names], np.int64).view(np.uint64), sets, similarity)
            at = np.flatnonzero(root != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in x], pa.int64()) for x in (at, root[at])], schema=EDGE)

        for batch in source:
            for *key, name, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if key != open_key:
                    if len(held) > 1:
                        yield found()
                    open_key, held = key, {}
                held[name] = (fp, shingles)
        if len(held) > 1:
            yield found()

    return run


def similar_links(docs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of text keys of similar texts; ``marks`` is a written table (text_key, fp, keys)."""
    rows = marks.select("text_key", "fp", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("key")
    members = materialise(salted_join(rows, met, ["key"], F.col("text_key"), salts=4).distinct(), "near-members")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(members.select("text_key")))
    sets = docs.select(F.xxhash64(whole()).alias("text_key"), whole().alias("text")).mapInArrow(trimmed(_sets(shared, FILTER_BITS)), "text_key long, shingles binary")
    sets = materialise(sets.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "near-sets")
    shared.destroy()
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = salted_join(members, sizes, ["key"], F.col("text_key"), salts=4)
    own = F.pmod(F.xxhash64("text_key", F.lit(1)), F.col("blocks")).cast("int")
    dealt = dealt.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "text_key", "fp").join(sets, "text_key")
    dealt = dealt.select("key", "bi", "bj", "text_key", "fp", "shingles").repartition("key", "bi", "bj")
    return dealt.sortWithinPartitions("key", "bi", "bj").mapInArrow(trimmed(_verify(similarity)), "a long, b long")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies of a row with a smaller doc_id."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(whole()).alias("text_key"),
        F.sha2(whole().cast("binary"), 256).alias("text_sha256"),
        whole().alias("text"),
    )
    schema = "doc_id long, text_key long, text_sha256 string, fp long, keys array<long>"
    marks = materialise(texts.mapInArrow(trimmed(_mark), schema), "near-marks")
    first = materialise(marks.groupBy("fp").agg(F.min("text_key").alias("first")), "near-fingerprints")
    same = salted_join(marks.select("text_key", "fp").distinct(), first, ["fp"], F.col("text_key"), written=True).select(F.col("text_key").alias("a"), F.col("first").alias("b"))
    close = links(first.select("fp"))
    for end in ("a", "b"):
        close = close.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_key")), end)
    close = close.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    edges = same.unionByName(close).unionByName(similar_links(docs, marks, similarity))
    roots = materialise(components(edges, "near-links"), "near-roots")
    named = marks.groupBy("doc_id", "text_key", "text_sha256").agg(F.count("*").alias("same_rows"))
    named = named.join(roots, F.col("text_key") == F.col("node"), "left").withColumn("component", F.coalesce("root", "text_key"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256", "same_rows")).alias("x")
    stays = named.groupBy("component").agg(least).select("x.doc_id", "x.text_sha256", "x.same_rows")
    return rows_of(docs, materialise(stays, "near-kept"))
