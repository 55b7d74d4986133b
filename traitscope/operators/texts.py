"""Corpus tables: distinct texts and the deduplication rules of the three problem types.

All of them group on the text, and copies of one text are merged before the shuffle, however
many there are. Smallest ids and times are fixed-width aggregates; ``dedup_last_label`` with
labels that are strings and ``dedup_by_prefix`` keep a string and are sorted by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot import dealt_join


def text_key(text: Column | str) -> Column:
    """128-bit key of a text: what the shuffles carry in place of the text."""
    return F.unhex(F.md5(text))


def dedup_texts(df: DataFrame, text: str = "text", text_id: str = "text_id") -> DataFrame:
    """One row per distinct text; its id is the smallest id of its copies."""
    return df.groupBy(F.col(text).alias("text")).agg(F.min(text_id).alias("text_id")).select("text_id", "text")


def dedup_keep_first(df: DataFrame, time: str, text: str = "text") -> DataFrame:
    """One row per distinct text at its first place in time (column ``first_at``)."""
    return df.groupBy(F.col(text).alias("text")).agg(F.min(time).alias("first_at")).select("first_at", "text")


def dedup_last_label(df: DataFrame, position: str, label: str, text: str = "text") -> DataFrame:
    """One row per distinct text at its first position, with the label it had last."""
    return (
        df.groupBy(F.col(text).alias("text"))
        .agg(F.min(position).alias("text_id"), F.max_by(label, position).alias("label"))
        .select("text_id", "text", "label")
    )


def dedup_by_prefix(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """Per prefix before ``sep``, the largest string in code point order."""
    return (
        df.groupBy(F.substring_index(F.col(column), sep, 1).alias("prefix"))
        .agg(F.max(column).alias("description"))
        .select("prefix", "description")
    )


def scatter_back(rows: DataFrame, scored: DataFrame, text: str = "text") -> DataFrame:
    """Give every original row the scores of its distinct text.

    ``scored`` has one row per ``text_key``. A text that many rows hold is dealt over the tasks.
    """
    return dealt_join(rows.withColumn("text_key", text_key(F.col(text))), scored, "text_key")
