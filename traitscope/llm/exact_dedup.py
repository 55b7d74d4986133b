"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes b0..bn-1 have the fingerprint sum(b_i * B^(n-1-i)) mod P under two
moduli. Chunks are hashed independently and combine by length-shifted arithmetic,
H(xy) = H(x) * B^len(y) + H(y), so a huge text is never hashed as one sequence. Texts with equal
fingerprints and lengths are then compared chunk by chunk with the text that stays.

Defined cases: a null text is the empty text. Of equal texts the row with the largest doc_id
stays; a null doc_id counts as the smallest. Rows that agree in doc_id and text stay rows of the
result, one of them kept. Columns other than doc_id and text are ignored by ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from traitscope.llm.common import barrier, rows_of, salted_join, trimmed, whole
from traitscope.session import materialise

#: Two primes below 2^31 and their bases; products of two residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 4096


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % prime
    return out


POWERS = [_powers(b, p, CHUNK)[::-1].copy() for b, p in zip(BASES, PRIMES)]


def chunk_hashes(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the CHUNK-byte pieces of ``data`` under each modulus; the first piece may be shorter.

    The short piece comes first, so that leading zeros pad it without a change of its hash.
    """
    lead = -len(data) % CHUNK
    if lead:
        data = np.concatenate([np.zeros(lead, np.uint8), data])
    rows = data.reshape(-1, CHUNK).astype(np.uint64)
    return [(rows @ w) % np.uint64(p) for w, p in zip(POWERS, PRIMES)]


def combine(left: int, right: int, right_length: int, which: int) -> int:
    """Hash of the concatenation of two byte sequences from their hashes."""
    return (left * pow(BASES[which], right_length, PRIMES[which]) + right) % PRIMES[which]


def fingerprint(data: bytes | np.ndarray) -> int:
    """Fingerprint of a byte sequence: both residues in one long."""
    array = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    if not len(array):
        return 0
    out = []
    for which, hashes in enumerate(chunk_hashes(array)):
        total = 0
        for h in hashes.tolist():
            total = combine(total, h, CHUNK, which)
        out.append(total)
    return out[0] << 31 | out[1]


def _bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


@F.arrow_udf(LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        yield pa.array([fingerprint(x) for x in _bytes_of(column.cast(pa.string()))], pa.int64())


def _chunks(size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of repeated groups as rows of at most ``size`` bytes of text."""
        for batch in source:
            fps, lengths, ids = (batch.column(i).to_pylist() for i in range(3))
            kept = [batch.column(i).to_pylist() for i in (3, 4)]
            out, held = [], 0
            for i, data in enumerate(_bytes_of(batch.column(5).cast(pa.string()))):
                for no, at in enumerate(range(0, max(len(data), 1), size)):
                    part = data[at : at + size].tobytes()
                    out.append((fps[i], lengths[i], ids[i], kept[0][i], kept[1][i], no, part))
                    held += len(part)
                    if held >= 1 << 24:
                        yield _rows(out)
                        out, held = [], 0
            if out:
                yield _rows(out)

    return run


FIELDS = "fp long, n_bytes long, doc_id long, keep_id long, copies long, part int, data binary"
ARROW = pa.schema([("fp", pa.int64()), ("n_bytes", pa.int64()), ("doc_id", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _confirmed(docs: DataFrame, repeated: DataFrame, chunk_bytes: int, per_salt: int) -> DataFrame:
    """(fp, n_bytes, doc_id) of the members whose bytes differ from those of the row that stays.

    Only texts of repeated fingerprints travel on. A group is dealt over one task per ``per_salt``
    copies, each of which gets the chunks of the row that stays.
    """
    hit = barrier(docs, fp=_fingerprints("text"), n_bytes=F.octet_length("text").cast("long"))
    hit = salted_join(hit, repeated, ["fp", "n_bytes"], F.col("doc_id"), written=True).select(
        "fp", "n_bytes", "doc_id", "keep_id", "copies", "text"
    )
    parts = materialise(hit.mapInArrow(trimmed(_chunks(chunk_bytes)), FIELDS), "exact-chunks")
    salts = F.ceil(F.col("copies") / per_salt).cast("long")
    own = parts.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), salts)
    )
    stays = (
        parts.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("fp", "n_bytes", "part")
        .agg(F.first("data").alias("whole"), F.first("copies").alias("copies"))
        .select("fp", "n_bytes", "part", "whole", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    )
    return (
        own.join(stays, ["fp", "n_bytes", "part", "salt"])
        .where(F.col("data") != F.col("whole"))
        .select("fp", "n_bytes", "doc_id")
        .distinct()
    )


def exact_dedup(docs: DataFrame, chunk_bytes: int = 1 << 18, per_salt: int = 256) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept and the text's SHA-256.

    First pass: fingerprints alone are shuffled. Second pass: texts of repeated fingerprints meet
    the text that stays, chunk by chunk. A member that differs (a collision of fingerprints) leaves
    its group; such members are grouped by SHA-256.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    marked = docs.select(
        "doc_id",
        _fingerprints("text").alias("fp"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
    marked = materialise(
        marked.groupBy("doc_id", "fp", "n_bytes", "text_sha256").agg(F.count("*").alias("rows")), "exact-marks"
    )
    groups = marked.groupBy("fp", "n_bytes").agg(F.max("doc_id").alias("keep_id"), F.sum("rows").alias("copies"))
    repeated = materialise(groups.where("copies > 1"), "exact-groups")
    differ = materialise(_confirmed(docs, repeated, chunk_bytes, per_salt), "exact-collisions")
    # A collision is never expected; where it happens the whole fingerprint is grouped by digest instead.
    broken = differ.select("fp", "n_bytes").distinct()
    sound = repeated.join(broken, ["fp", "n_bytes"], "left_anti").select("fp", "n_bytes", "keep_id", "copies")
    suspect = marked.join(broken, ["fp", "n_bytes"], "left_semi")
    regrouped = suspect.groupBy("fp", "n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep_id2"), F.sum("rows").alias("copies2"))
    out = salted_join(marked, sound, ["fp", "n_bytes"], F.col("doc_id"), how="left")
    out = salted_join(out, regrouped, ["fp", "n_bytes", "text_sha256"], F.col("doc_id"), how="left")
    out = out.select(
        "doc_id",
        F.coalesce("keep_id2", "keep_id", "doc_id").alias("keep_id"),
        F.coalesce("copies2", "copies", "rows").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_copy"),
        "text_sha256",
        F.col("rows").alias("same_rows"),
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256", "same_rows")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text no row with a larger doc_id repeats.

    Of rows that agree in doc_id and text the first by its other columns stays.
    """
    stays = materialise(exact_dedup(docs).where("kept").select("doc_id", "text_sha256", "same_rows"), "exact-kept")
    return rows_of(docs, stays)
