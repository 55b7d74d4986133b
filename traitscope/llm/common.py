"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscope.session import bound_batches, discard, materialise, ship_package

#: Words are runs of anything but blank and the control characters TAB to CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else; str.lower would touch other letters.
LOWER = {c: c + 32 for c in range(65, 91)}
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Steps end in written tables, so the shuffle files of a step may go when it is done.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound the bytes of their batches and the life of shuffle files for this session."""
    ship_package(spark)
    bound_batches(spark)
    spark.conf.set(CLEANUP_SETTING, "true")


def trimmed(run):
    """An Arrow-batch function that gives freed memory back when a task ends.

    Python workers serve many tasks; what one of them freed would else stay with the worker.
    """

    def outer(source):
        yield from run(source)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return outer


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def fold_words(text: str) -> list[str]:
    """Words of a text with A-Z lowered."""
    return WORD.findall(lowered(text))


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


def whole(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id falls in fold -1."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections read, instead of evaluating them again for each use."""
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    kept = df.columns
    return df.select(*kept, F.explode(F.array(packed)).alias("_new")).select(*kept, "_new.*")


#: Rows of a written table that may be sent to every task; its columns are a few numbers and names.
SENT = 20_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    salts: int = 16,
    how: str = "inner",
    written: bool = False,
    hint: str = "merge",
) -> DataFrame:
    """Join on ``keys`` (nulls match) with every key of ``left`` dealt over ``salts`` tasks.

    ``right`` holds few rows per key and is repeated ``salts`` times; ``spread`` is a long that
    tells rows of one key apart. Beyond that many parts Spark's own skew handling goes on. The
    repeated side is never broadcast, as Spark judges its size without the repetition. Where
    ``right`` is a written table its rows are counted first: up to SENT of them are broadcast, and
    ``left`` is not shuffled. With ``hint`` "shuffle_hash" the parts of ``right`` are held in memory
    and ``left``, far wider or longer, is not sorted.
    """
    few = written and right.count() <= SENT
    a = left if few else left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    named = [F.col(k).alias(f"_r_{k}") for k in keys]
    rest = [F.col(c) for c in right.columns if c not in keys]
    if few:
        b, on = F.broadcast(right.select(*named, *rest)), F.lit(True)
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_r_salt")
        b, on = right.select(*named, *rest, salt).hint(hint), F.col("_salt") == F.col("_r_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(b, on, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def rows_of(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, named by a written table (doc_id, text_sha256, same_rows).

    Where ``same_rows`` rows agree in doc_id and text, the first by its other columns stands for them.
    """
    names = docs.columns
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        F.sha2(whole().cast("binary"), 256).alias("_sha"),
        F.struct(*names).alias("_row"),
    )

    def rows(which: str) -> DataFrame:
        keys = stays.where(which).select(F.col("doc_id").alias("_k"), F.col("text_sha256").alias("_s"))
        return keyed.join(keys, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left_semi")

    several = rows("same_rows > 1").groupBy("_id", "_sha").agg(F.min("_row").alias("_row"))
    return rows("same_rows = 1").select("_row").unionByName(several.select("_row")).select("_row.*").select(*names)


def components(edges: DataFrame, label: str, salts: int = 8) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps; every round is a written table, so a lost
    executor costs at most one round. A node with very many edges is dealt over ``salts`` tasks,
    and its minimum is combined before the shuffle. Nodes without an edge to another node are absent.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    state = None
    while True:
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == tuple(row) or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        state = tuple(row)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, ["a"], F.col("b"), salts).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), label)
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"], F.col("b"), salts).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        discard(large)
