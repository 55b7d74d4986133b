"""Joins whose hot keys are dealt over the tasks.

One text may be a third of all rows. A sketch of frequent keys, of fixed size and merged on the
executors, names the keys that are more than a task's share; only those are split, each into as many
parts as its share of the rows asks for. The other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys the sketch returns and tracks. A key that it leaves out holds under a thousandth of the rows.
MOST, TRACKED = 1000, 10_000
#: Parts per task's share, so that the hashes of a key's parts reach nearly every task.
PARTS = 8


def hot_keys(rows: DataFrame, key: str, tasks: int) -> DataFrame | None:
    """(_hash, _parts) of the keys with more rows than an even task; None where there are none.

    At most MOST rows, and at most ``PARTS * tasks`` parts and one per key in all.
    """
    hashed = rows.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    found = hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {MOST}, {TRACKED})").alias("top")).first()
    hot = [(x["item"], -(-PARTS * tasks * x["count"] // found["n"])) for x in found["top"] or [] if x["count"] * tasks > found["n"]]
    return rows.sparkSession.createDataFrame(hot, "_hash long, _parts int") if hot else None


def dealt_join(left: DataFrame, right: DataFrame, key: str, spread: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on ``key`` ("inner" or "left") with the hot keys of ``left`` dealt over the tasks.

    ``right`` has few rows per key; those of hot keys are repeated once per part. ``spread`` tells
    rows of one key apart; without it the other columns of ``left`` do. Rows that agree in all of
    these stay together. Null keys match nothing and are not dealt.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(left, key, tasks)
    if hot is None:
        return left.join(right, key, how)
    rest = [c for c in left.columns if c != key]
    spread = spread if spread is not None else F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    # At most MOST rows are broadcast.
    known = lambda df: df.join(F.broadcast(hot), F.xxhash64(key) == F.col("_hash"), "left").drop("_hash")
    parts = F.coalesce("_parts", F.lit(1))
    a = known(left).withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    b = known(right).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b.hint("merge"), [key, "_part"], how).drop("_part")
