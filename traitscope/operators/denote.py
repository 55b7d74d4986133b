"""Denotation: the table of which predicates hold for which texts.

The wide form is (text_id, phi), ``phi`` an array with one entry per predicate. It is a
projection of the texts: no product of texts and predicates is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, truncate_tokens
from ..session import materialise
from ..sources.caches import VerdictCache
from .hot import dealt_join
from .scorers import Scorer, TokenScorer
from .texts import dedup_texts, text_key


def phi_column(text: Column | str, predicates: Sequence[str], scorer: Scorer) -> Column:
    return F.array(*[scorer.bit(text, p) for p in predicates])


def denote(
    texts: DataFrame,
    predicates: Sequence[str],
    scorer: Scorer | None = None,
    cache: VerdictCache | None = None,
    max_tokens: int | None = None,
) -> DataFrame:
    """Score every row of ``texts`` (text_id, text) for every predicate: (text_id, phi).

    Native scorers are evaluated in place. Other scorers see each distinct text once, and
    only for predicates without a verdict in ``cache``; the answers are written before use
    and then brought back to all rows that hold the text. ``max_tokens`` shortens what the
    scorer is shown.
    """
    scorer = scorer or TokenScorer()
    shown = truncate_tokens("text", max_tokens) if max_tokens else F.col("text")
    if scorer.native:
        return texts.select("text_id", phi_column(shown, predicates, scorer).alias("phi"))
    rows = texts.select("text_id", shown.alias("text")).withColumn("text_key", text_key("text"))
    # One row per text by its smallest id: a fixed-width aggregate, no text in a buffer.
    distinct = rows.join(rows.groupBy("text_key").agg(F.min("text_id").alias("text_id")).select("text_id"), "text_id", "left_semi")
    distinct = distinct.select("text_key", "text")
    found = score_distinct(distinct, predicates, scorer, cache)
    wide = found.groupBy("text_key").agg(
        F.array(
            *[
                F.coalesce(F.max(F.when(F.col("predicate") == p, F.col("value"))), F.lit(0.0))
                for p in predicates
            ]
        ).alias("phi")
    )
    # A text whose calls all failed has no verdict at all: zeros, as for a single failed call.
    none = F.array(*[F.lit(0.0)] * len(predicates))
    joined = dealt_join(rows.select("text_id", "text_key"), wide, "text_key", F.col("text_id"), "left")
    return joined.select("text_id", F.coalesce("phi", none).alias("phi"))


def missing_pairs(distinct: DataFrame, predicates: Sequence[str], known: DataFrame) -> DataFrame:
    """(text_key, text, predicate) without a verdict.

    Verdicts are first gathered per text (at most one per predicate), so the join moves each
    text once and the pairs are made after it, next to the scorer.
    """
    wanted = F.array(*[F.lit(p) for p in predicates])
    held = known.filter(F.col("predicate").isin(list(predicates))).groupBy("text_key").agg(
        F.collect_set("predicate").alias("held")
    )
    todo = F.array_except(wanted, F.coalesce(F.col("held"), F.array().cast("array<string>")))
    return distinct.join(held, "text_key", "left").select("text_key", "text", F.explode(todo).alias("predicate"))


def score_distinct(
    distinct: DataFrame, predicates: Sequence[str], scorer: Scorer, cache: VerdictCache | None
) -> DataFrame:
    """(text_key, predicate, value) for all pairs of distinct texts and predicates."""
    if cache is None:
        wanted = F.array(*[F.lit(p) for p in predicates])
        pairs = distinct.select("text_key", "text", F.explode(wanted).alias("predicate"))
        return materialise(scorer.score_pairs(pairs).select("text_key", "predicate", "value"), "verdicts")
    todo = missing_pairs(distinct, predicates, cache.read(scorer.name))
    cache.append(scorer.score_pairs(todo), scorer.name)
    known = cache.read(scorer.name).filter(F.col("predicate").isin(list(predicates)))
    return known.join(distinct.select("text_key"), "text_key", "left_semi").select("text_key", "predicate", "value")


def inference_count(
    texts: DataFrame, predicates: Sequence[str], scorer: Scorer, cache: VerdictCache | None = None
) -> DataFrame:
    """Verdicts that a call of ``denote`` would compute anew: pairs for the token scorer, misses else."""
    if scorer.native:
        return texts.agg((F.count("*") * len(predicates)).alias("inferences"))
    distinct = dedup_texts(texts).withColumn("text_key", text_key("text"))
    if cache is None:
        return distinct.agg((F.count("*") * len(predicates)).alias("inferences"))
    return missing_pairs(distinct, predicates, cache.read(scorer.name)).agg(F.count("*").alias("inferences"))


def denote_pairs(pairs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Score the i-th text against the i-th predicate: a table with both columns, no product."""
    return (scorer or TokenScorer()).score_pairs(pairs)


def distinct_denotation(texts: DataFrame, predicates: Sequence[str], scorer: Scorer | None = None) -> DataFrame:
    """(text_id, phi), one row per distinct text.

    With a native scorer the texts are scored before the shuffle, which then moves a 16-byte
    key and a few bits per row instead of the text.
    """
    scorer = scorer or TokenScorer()
    if not scorer.native:
        return denote(dedup_texts(texts), predicates, scorer)
    scored = texts.select(text_key("text").alias("key"), "text_id", phi_column("text", predicates, scorer).alias("phi"))
    return scored.groupBy("key", "phi").agg(F.min("text_id").alias("text_id")).select("text_id", "phi")


def token_matches(texts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(text_id, predicate_id) of the pairs that hold, for a predicate table of any length.

    An equi-join of distinct tokens and predicates; use it where the predicates are too many
    for one array per text. Spark decides from the table sizes which side to broadcast.
    """
    held = texts.select("text_id", F.explode(F.array_distinct(tokens("text"))).alias("predicate"))
    return held.join(predicates.select("predicate_id", "predicate"), "predicate").select("text_id", "predicate_id")


def to_long(denotation: DataFrame) -> DataFrame:
    """(text_id, predicate_id, value) from the wide form.

    The outer generator keeps Catalyst from adding a filter on the array's size, which would
    score every text a second time below the projection.
    """
    return denotation.select("text_id", F.posexplode_outer("phi").alias("predicate_id", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def new_predicates(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct proposed predicates that are not known yet."""
    return proposed.select("predicate").distinct().join(known.select("predicate"), "predicate", "left_anti")
