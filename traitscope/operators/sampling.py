"""Seeded samples and extremes. Orders come from md5(seed:id), never from rand(), so the
same rows are picked on every run, on any number of partitions and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCREEN = 256  # fixed value: texts on which candidates are screened


def hash_order(seed: int, key: Column | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))


def sample_ids(df: DataFrame, n: int, seed: int = 0, key: str = "text_id", total: int | None = None) -> DataFrame:
    """``n`` ids without replacement: the smallest hashes.

    Each partition keeps its own first ``n`` before they meet. With a known large ``total``
    only ids under a hash bound that lets through about 8n go that far; should fewer than
    ``n`` pass, the bound is lifted.
    """
    ids = df.select(key).withColumn("_h", hash_order(seed, key))
    if total and total > 64 * n:
        bound = f"{min(int(16 ** 8 * 8 * n / total) + 1, 16 ** 8 - 1):08x}"
        near = ids.filter(F.col("_h") < bound)
        if near.limit(n).count() == n:
            ids = near
    return ids.orderBy("_h", key).limit(n).select(key)


def screen_sample(df: DataFrame, n: int = SCREEN, seed: int = 0, key: str = "text_id", total: int | None = None) -> DataFrame:
    """The rows of a seeded sample; only the ids are ranked, and at most ``n`` are sent out."""
    return df.join(F.broadcast(sample_ids(df, n, seed, key, total)), key, "left_semi")


uniform_sample = screen_sample


def extremes_sample(
    df: DataFrame, target: str, budget: int, n_extreme: int = 5, seed: int = 0, key: str = "text_id"
) -> DataFrame:
    """Rows for a proposer prompt: the top and bottom by ``target`` and a random rest.

    The random part may repeat extremes. Columns: those of ``df`` plus ``part``.
    """
    n = min(n_extreme, budget // 2)
    narrow = df.select(key, target)
    top = narrow.orderBy(F.col(target).desc(), key).limit(n).select(key, F.lit("top").alias("part"))
    low = narrow.orderBy(F.col(target).asc(), F.col(key).desc()).limit(n).select(key, F.lit("bottom").alias("part"))
    rest = sample_ids(df, max(budget - 2 * n, 0), seed, key).select(key, F.lit("random").alias("part"))
    # At most ``budget`` ids, a number that comes from the length of a prompt.
    return df.join(F.broadcast(top.unionByName(low).unionByName(rest)), key)


def avg_token_length(df: DataFrame, n: int = 500, seed: int = 0, key: str = "text_id") -> DataFrame:
    """Mean number of tokens over a seeded sample of at most ``n`` texts."""
    from ..functions.text import tokens

    return screen_sample(df, n, seed, key).agg(F.avg(F.size(tokens("text"))).alias("avg_tokens"))


def prompt_budget(avg_tokens: Column, context: int = 16000, max_tokens: int | None = 256, overhead: int = 20) -> Column:
    """Samples that fit a prompt: a quarter of the context and 1024 tokens stay free.

    ``max_tokens=None`` with ``overhead=0`` is the plain quotient without a cap per sample.
    """
    room = (context - 1024) * 0.75
    length = F.least(avg_tokens, F.lit(float(max_tokens))) if max_tokens else avg_tokens
    return F.floor(F.lit(room) / (length + F.lit(float(overhead)))).cast("int")
