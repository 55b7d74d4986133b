"""Scorers (is the predicate true of the text?) and committers (which one fits best?)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts
from ..functions.text import col, first_match, parse_assignment, parse_similarity, parse_yes_no, token_bit
from ..session import bound_batches, materialise

BATCH = 16


def call_batches(
    df: DataFrame, fn: Callable[[list], list], inputs: Sequence[str], output: T.StructField, batch: int = BATCH
) -> DataFrame:
    """Append ``output`` = fn(list of inputs), called on at most ``batch`` rows at a time.

    With one input column ``fn`` gets a list of values, with several a list of tuples.
    """
    bound_batches(df.sparkSession)
    schema = T.StructType(df.schema.fields + [output])
    inputs = list(inputs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(inputs) == 1:
                args = frame[inputs[0]].tolist()
            else:
                args = list(frame[inputs].itertuples(index=False, name=None))
            out: list = []
            for i in range(0, len(args), batch):
                part = list(fn(args[i : i + batch]))
                if len(part) != len(args[i : i + batch]):
                    raise ValueError("the batch function must return one value per input")
                out.extend(part)
            yield frame.assign(**{output.name: pd.Series(out, index=frame.index, dtype=object)})

    return df.mapInPandas(run, schema)


class Scorer:
    """Scores (text, predicate) pairs. ``native`` scorers are plain column expressions."""

    name = "scorer"
    native = False

    def bit(self, text: Column | str, predicate: str) -> Column:
        """Score column for one fixed predicate (native scorers only)."""
        raise NotImplementedError

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        """Append ``value`` to a table with ``text`` and ``predicate``."""
        raise NotImplementedError


class TokenScorer(Scorer):
    """1 if the predicate is one whitespace token of the text (built in, JVM only)."""

    name = "token"
    native = True

    def bit(self, text: Column | str, predicate: str) -> Column:
        return token_bit(text, predicate)

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        from ..functions.text import token_predicate

        return pairs.withColumn("value", token_predicate("text", "predicate"))


class BatchScorer(Scorer):
    """Any function from a list of (hypothesis, text) pairs to a list of scores."""

    def __init__(self, fn: Callable[[list[tuple[str, str]]], list[float]], name: str, batch: int = BATCH):
        self.fn, self.name, self.batch = fn, name, batch

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        out = T.StructField("value", T.DoubleType())
        fn = self.fn

        def floats(batch: list) -> list:
            return [None if v is None else float(v) for v in fn(batch)]

        return call_batches(pairs, floats, ["predicate", "text"], out, self.batch)


class PromptScorer(Scorer):
    """A language model behind ``fn(list of prompts) -> list of responses``.

    Prompts are built and answers are read by column expressions; a failed call (None)
    leaves a null verdict, which counts as 0.
    """

    def __init__(
        self,
        fn: Callable[[list[str]], list[str | None]],
        name: str,
        template: str = prompts.VALIDATE,
        batch: int = BATCH,
    ):
        self.fn, self.template, self.batch = fn, template, batch
        self.name = f"{name}:{hashlib.md5(template.encode()).hexdigest()[:8]}"

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        asked = pairs.withColumn("prompt", prompts.validator_prompt("predicate", "text", self.template))
        told = call_batches(asked, self.fn, ["prompt"], T.StructField("response", T.StringType()), self.batch)
        value = F.when(F.col("response").isNotNull(), parse_yes_no("response").cast("double"))
        return told.withColumn("value", value).drop("prompt", "response")


class Committer:
    """Forces each text to its best predicate: ``commit`` gives a 0/1 array per text."""

    def commit(self, texts: DataFrame, predicates: list[str]) -> DataFrame:
        raise NotImplementedError


class FirstMatchCommitter(Committer):
    """First predicate that is a substring of the text, else the last one."""

    def commit(self, texts: DataFrame, predicates: list[str]) -> DataFrame:
        choice = first_match("text", predicates)
        bits = F.transform(
            F.sequence(F.lit(0), F.lit(len(predicates) - 1)), lambda i: (i == F.col("choice")).cast("int")
        )
        return texts.withColumn("choice", choice).withColumn("phi", bits).drop("choice")


class PromptCommitter(Committer):
    """A language model that answers with an index in brackets.

    Each distinct text is asked about once. With a ``cache`` (an ``EmbeddingCache``) answers are
    kept by template, predicates and text, so a later call pays for new texts alone.
    """

    def __init__(
        self,
        fn: Callable[[list[str]], list[str | None]],
        template: str = prompts.ASSIGN,
        add_null: bool = False,
        batch: int = BATCH,
        cache=None,
        name: str = "committer",
    ):
        self.fn, self.template, self.add_null, self.batch = fn, template, add_null, batch
        self.cache, self.name = cache, name

    def commit(self, texts: DataFrame, predicates: list[str]) -> DataFrame:
        rows = texts.withColumn("_key", F.unhex(F.md5("text")))
        if self.cache is not None:
            asked = [self.template, str(self.add_null), *predicates]
            digest = hashlib.md5("\0".join(asked).encode()).hexdigest()[:16]
            found = self.cache.embed(texts, _Answers(self, predicates, f"{self.name}-{digest}"))
            return found.withColumn("phi", F.transform("embedding", lambda x: x.cast("int"))).drop("embedding")
        first = rows.groupBy("_key").agg(F.min("text_id").alias("text_id")).select("text_id")
        answers = self.ask(rows.join(first, "text_id", "left_semi").select("_key", "text"), predicates)
        answers = materialise(answers.select("_key", "phi"), "committed")
        # A text may be a third of all rows: its answer is dealt over tasks with the rows.
        salts = 8
        dealt = answers.select(F.col("_key").alias("_k"), "phi", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
        own = F.pmod(F.xxhash64("text_id"), F.lit(salts))
        return rows.join(dealt, (F.col("_key") == F.col("_k")) & (own == F.col("_s"))).select(*texts.columns, "phi")

    def ask(self, texts: DataFrame, predicates: list[str]) -> DataFrame:
        """Append ``phi``, one call per row."""
        listed = F.array(*[F.lit(p) for p in predicates])
        asked = texts.withColumn("prompt", prompts.assign_prompt(listed, "text", self.add_null, self.template))
        told = call_batches(asked, self.fn, ["prompt"], T.StructField("response", T.StringType()), self.batch)
        return told.withColumn("phi", parse_assignment("response", len(predicates))).drop("prompt", "response")


class _Answers:
    """The answers of a committer as vectors, for a cache of vectors."""

    def __init__(self, committer: PromptCommitter, predicates: list[str], name: str):
        self.committer, self.predicates, self.name = committer, predicates, name

    def embed(self, texts: DataFrame) -> DataFrame:
        return self.committer.ask(texts, self.predicates).withColumnRenamed("phi", "embedding")


class SimilarityJudge:
    """Judges whether two descriptions mean the same: yes 1, related 0.5, no 0."""

    def __init__(self, fn: Callable[[list[str]], list[str | None]], template: str = prompts.SIMILARITY, batch: int = BATCH):
        self.fn, self.template, self.batch = fn, template, batch

    def judge(self, pairs: DataFrame, a: str, b: str) -> DataFrame:
        asked = pairs.withColumn("prompt", prompts.similarity_prompt(col(a), col(b), self.template))
        told = call_batches(asked, self.fn, ["prompt"], T.StructField("response", T.StringType()), self.batch)
        return told.withColumn("judged", parse_similarity("response")).drop("prompt", "response")
