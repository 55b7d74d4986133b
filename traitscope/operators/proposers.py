"""Proposers: where candidate predicates come from."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts
from ..functions.text import is_refusal, parse_proposals, tokens
from .sampling import avg_token_length, extremes_sample, prompt_budget, uniform_sample
from .scorers import call_batches


@dataclass
class Proposal:
    """What a proposer answered, and what it was shown."""

    descriptions: list[str]
    prompt: str = ""
    shown: list[tuple[str, float | None]] = field(default_factory=list)
    raw_responses: list[str] = field(default_factory=list)
    originals: list[str] = field(default_factory=list)
    duration: float = 0.0


def token_scores(df: DataFrame, target: str) -> DataFrame:
    """(predicate, score): sum over the texts of the token's count times the centred target.

    Sum and count per token are merged before the shuffle; the mean enters at the end, on
    one row per token.
    """
    mean = df.agg(F.avg(target).alias("m")).scalar()
    toks = df.select(F.explode(tokens("text")).alias("predicate"), F.col(target).cast("double").alias("y"))
    sums = toks.groupBy("predicate").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    return sums.select("predicate", (F.col("s") - F.col("c") * mean).alias("score"))


def token_scores_many(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target_id, predicate, score) for several targets from one tokenisation and one shuffle."""
    means = df.agg(F.array(*[F.avg(t) for t in targets]).alias("m")).scalar()
    toks = df.select(F.explode(tokens("text")).alias("predicate"), *targets)
    sums = toks.groupBy("predicate").agg(F.count("*").alias("c"), *[F.sum(t).alias(f"s{i}") for i, t in enumerate(targets)])
    each = F.posexplode_outer(F.array(*[F.col(f"s{i}") - F.col("c") * F.get(means, F.lit(i)) for i in range(len(targets))]))
    return sums.select("predicate", each.alias("target_id", "score"))


def token_propose_many(df: DataFrame, targets: Sequence[str], n: int = 5) -> DataFrame:
    """(target_id, place, predicate): the ``n`` best tokens of each target.

    Spark keeps the first ``n`` per target of each partition before it ranks them.
    """
    order = Window.partitionBy("target_id").orderBy(F.round("score", 9).desc(), "predicate")
    ranked = token_scores_many(df, targets).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= n).select("target_id", "place", "predicate")


def token_propose(df: DataFrame, target: str, n: int = 5) -> DataFrame:
    """The ``n`` tokens that go most with a high target; ties by token."""
    return token_scores(df, target).orderBy(F.round("score", 9).desc(), "predicate").limit(n)


def distinct_tokens(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct tokens in code point order."""
    toks = df.select(F.explode(tokens("text")).alias("predicate")).distinct()
    return toks.orderBy("predicate").limit(n)


def scored_context(samples: DataFrame, score: str, key: str = "text_id", max_tokens: int = 256) -> DataFrame:
    """One row, ``lines``: the sample lines of a prompt, lowest score first.

    ``samples`` is already cut to a prompt budget, so one row can hold it.
    """
    held = F.collect_list(F.struct(F.col(score).cast("double").alias("score"), F.col(key).alias("id"), F.col("text")))
    return samples.agg(held.alias("s")).select(prompts.sample_lines(F.col("s"), max_tokens).alias("lines"))


def unscored_context(samples: DataFrame, key: str = "text_id", max_tokens: int = 256, seed: int = 0) -> DataFrame:
    """Sample lines without scores, in the seeded order."""
    from .sampling import hash_order

    held = F.sort_array(F.collect_list(F.struct(hash_order(seed, key).alias("h"), F.col("text"))))
    return samples.agg(held.alias("s")).select(prompts.sample_lines(F.col("s"), max_tokens, scored=False).alias("lines"))


def merge_proposals(pool: DataFrame, new: DataFrame, extra: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Pool (place, predicate) followed by new predicates it lacks and the user's own.

    ``limit`` caps what is taken from ``new``, in the order of its ``place``.
    """
    taken = new.select("place", "predicate")
    if limit is not None:
        taken = taken.orderBy("place", "predicate").limit(limit)
    parts = pool.select(F.lit(0).alias("part"), "place", "predicate").unionByName(
        taken.select(F.lit(1).alias("part"), "place", "predicate")
    )
    if extra:
        own = pool.sparkSession.createDataFrame([(2, i, e) for i, e in enumerate(extra)], "part int, place int, predicate string")
        parts = parts.unionByName(own)
    return parts.groupBy("predicate").agg(F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", "predicate")


class Proposer:
    """Proposes predicates that tell high targets from low ones."""

    def __init__(self, n: int = 5, own: dict[str, list[str]] | None = None):
        self.n = n
        self.own = own or {}

    def propose(self, df: DataFrame, target: str, goal: str | None = None) -> Proposal:
        """``df`` has text_id, text and the target column."""
        raise NotImplementedError

    def propose_many(self, df: DataFrame, targets: Sequence[str], goal: str | None = None) -> Iterator[Proposal]:
        """One proposal per target column, in order. Made on demand here, as a call may cost money."""
        for target in targets:
            yield self.propose(df, target, goal)

    def propose_unscored(self, df: DataFrame, goal: str | None = None) -> Proposal:
        raise NotImplementedError

    def _with_own(self, proposal: Proposal, goal: str | None) -> Proposal:
        proposal.descriptions += [d for d in self.own.get(goal or "", []) if d not in proposal.descriptions]
        return proposal


class TokenProposer(Proposer):
    """Built in: single tokens."""

    def propose(self, df: DataFrame, target: str, goal: str | None = None) -> Proposal:
        rows = token_propose(df, target, self.n).collect()
        return self._with_own(Proposal([r["predicate"] for r in rows]), goal)

    def propose_many(self, df: DataFrame, targets: Sequence[str], goal: str | None = None) -> Iterator[Proposal]:
        """All targets from one pass over the texts; at most n rows per target come back."""
        rows = sorted(token_propose_many(df, targets, self.n).collect(), key=lambda r: r["place"])
        for i in range(len(targets)):
            yield self._with_own(Proposal([r["predicate"] for r in rows if r["target_id"] == i]), goal)

    def propose_unscored(self, df: DataFrame, goal: str | None = None) -> Proposal:
        return Proposal([r["predicate"] for r in distinct_tokens(df, self.n).collect()])


class PromptProposer(Proposer):
    """A language model behind ``fn(list of prompts) -> list of responses``."""

    TRIES = 2

    def __init__(
        self,
        fn: Callable[[list[str]], list[str | None]],
        n: int = 5,
        rounds: int = 1,
        extremes: int = 5,
        samples: int | None = None,
        context: int = 16000,
        seed: int = 0,
        simple: bool = False,
        application: bool = False,
        template: str | None = None,
        own: dict[str, list[str]] | None = None,
    ):
        super().__init__(n, own)
        self.fn, self.rounds, self.extremes, self.samples = fn, rounds, extremes, samples
        self.context, self.seed, self.simple = context, seed, simple
        scored = prompts.PROPOSE_SCORED_SIMPLE if simple else prompts.PROPOSE_SCORED
        self.template = template or (prompts.PROPOSE_SCORED_APPLICATION if application else scored)
        self.unscored = template or (prompts.PROPOSE_UNSCORED_SIMPLE if simple else prompts.PROPOSE_UNSCORED)

    def _budget(self, df: DataFrame) -> int:
        if self.samples is not None:
            return self.samples
        return avg_token_length(df).select(prompt_budget(F.col("avg_tokens"), self.context).alias("b")).first()["b"]

    def propose(self, df: DataFrame, target: str, goal: str | None = None) -> Proposal:
        samples = extremes_sample(df.select("text_id", "text", target), target, self._budget(df), self.extremes, self.seed)
        # At most the prompt budget of rows.
        shown = [(r["text"], float(r[target])) for r in samples.collect()]
        lines = scored_context(samples, target)
        return self._with_own(self._ask(lines, goal, self.template, shown), goal)

    def propose_unscored(self, df: DataFrame, goal: str | None = None) -> Proposal:
        samples = uniform_sample(df.select("text_id", "text"), self._budget(df), self.seed)
        lines = unscored_context(samples, seed=self.seed)
        return self._ask(lines, goal, self.unscored, [])

    def _ask(self, lines: DataFrame, goal: str | None, template: str, shown: list) -> Proposal:
        began = time.time()
        prompt = lines.select(prompts.proposer_prompt(F.col("lines"), goal, [], self.n, template).alias("p")).first()["p"]
        spark = lines.sparkSession
        raw: list[str] = []
        for _ in range(self.TRIES):
            asked = spark.createDataFrame([(i, prompt) for i in range(self.rounds)], "round int, prompt string")
            told = call_batches(asked, self.fn, ["prompt"], T.StructField("response", T.StringType()))
            kept = told.filter(~is_refusal("response")).select("round", "response").collect()
            raw += [r["response"] for r in sorted(kept, key=lambda r: r["round"])]
            if len(raw) >= self.rounds:
                raw = raw[: self.rounds]
                break
        if not raw:
            return Proposal([], prompt, shown)
        answers = spark.createDataFrame(list(enumerate(raw)), "place int, response string")
        parsed = answers.select("place", parse_proposals("response").alias("d")).collect()
        originals = [d for r in sorted(parsed, key=lambda r: r["place"]) for d in r["d"]]
        return Proposal(originals[: self.n * self.rounds], prompt, shown, raw, originals, time.time() - began)
