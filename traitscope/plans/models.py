"""The coordinate search over predicates, and its three problems.

The driver holds the K predicates, their directions and the candidate pool; every look at
the texts is a Spark job over one of two written tables: ``base`` (text, label or time
bucket, embedding) and ``state`` (embedding and current denotation, rewritten when a
predicate changes).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators import agreement, geometry, patterns
from ..operators.denote import denote, inference_count, phi_column
from ..operators.embedders import Embedder, HashedBowEmbedder
from ..operators.passes import Held, LightSearch, Passes, Rows, Search, count_rows, solve
from ..operators.proposers import Proposer, TokenProposer
from ..operators.sampling import SCREEN, screen_sample
from ..operators.scorers import Committer, FirstMatchCommitter, Scorer, SimilarityJudge, TokenScorer
from ..session import materialise, shared_folder
from ..sources.caches import EmbeddingCache, VerdictCache
from . import solvers
from .series import path_weights, series_path

# Softmax temperature, rounds of the search, candidates tried per predicate.
TEMPERATURE, ROUNDS, EXPLORE = 0.1, 10, 5
HELD_BITS = 20  # pattern tables of at most 2^20 rows may be gathered on the driver


@dataclass
class Reference:
    """A known answer: wide denotation (text_id, phi) and the predicates' names."""

    denotation: DataFrame
    predicates: list[str] | None = None


def ids(row) -> dict:
    return {"ref_id": row["ref_id"], "pred_id": row["pred_id"]}


@dataclass
class Evaluation:
    predicates: list[str]
    loss: float
    before: DataFrame
    after: DataFrame | None = None
    metrics: dict = field(default_factory=dict)
    details: list[dict] = field(default_factory=list)
    aligned: list[str] | None = None


@dataclass
class Step:
    tag: str
    evaluation: Evaluation


@dataclass
class Explanation:
    """Result of a fit. ``denotation`` is (text_id, phi), committed where the model commits."""

    predicates: list[str]
    denotation: DataFrame
    loss: float
    trajectory: list[Step]
    aligned_predicates: list[str] | None = None
    surface_similarity_score: float | None = None
    f1_similarity_score: float | None = None

    def matches(self, texts: DataFrame) -> DataFrame:
        """(predicate, text, value): the result as a long table."""
        names = F.array(*[F.lit(p) for p in self.predicates])
        long = self.denotation.select("text_id", F.posexplode_outer("phi").alias("i", "value"))
        named = long.select("text_id", F.element_at(names, F.col("i") + 1).alias("predicate"), F.col("value").cast("int"))
        return named.join(texts.select("text_id", "text"), "text_id").select("predicate", "text", "value")

    def details_table(self) -> DataFrame:
        """(step, measure, ref_id, pred_id, value): the F1 of every pair of a reference and a found
        predicate, the metrics of each one-to-one match, and the similarity of each aligned pair."""
        spark = self.denotation.sparkSession
        rows = [
            (i, d["measure"], d["ref_id"], d["pred_id"], None if d["value"] is None else float(d["value"]))
            for i, s in enumerate(self.trajectory)
            for d in s.evaluation.details
        ]
        return spark.createDataFrame(rows, "step int, measure string, ref_id int, pred_id int, value double")

    def trajectory_table(self) -> DataFrame:
        spark = self.denotation.sparkSession
        rows = [
            (i, s.tag, s.evaluation.predicates, float(s.evaluation.loss), {a: float(b) for a, b in s.evaluation.metrics.items() if b is not None})
            for i, s in enumerate(self.trajectory)
        ]
        return spark.createDataFrame(rows, "step int, tag string, predicates array<string>, loss double, metrics map<string,double>")


class Model:
    """Shared search. A problem of your own overrides ``directions_solver`` and ``losses``."""

    commits = False
    absolute = False
    target: str | None = None

    def __init__(
        self,
        texts: DataFrame,
        k: int,
        goal: str | None = None,
        embedder: Embedder | None = None,
        scorer: Scorer | None = None,
        proposer: Proposer | None = None,
        committer: Committer | None = None,
        judge: SimilarityJudge | None = None,
        reference: Reference | None = None,
        verdicts: VerdictCache | None = None,
        vectors: EmbeddingCache | None = None,
        temperature: float = TEMPERATURE,
        screen: int = SCREEN,
        rounds: int = ROUNDS,
        explore: int = EXPLORE,
        random_update: bool = False,
        max_tokens: int | None = None,
        binary: bool = True,
        gain: float | None = None,
        seed: int = 0,
    ):
        """``texts`` has distinct texts: text_id, text and, by problem, ``label`` or ``t``. It is
        read once.

        ``binary=False`` is for scorers with values other than 0 and 1: patterns are then
        grouped as arrays and stay in Spark. ``gain`` is what a step of a direction search must
        win to go on; each problem has its own.
        """
        self.spark = texts.sparkSession
        self.texts, self.k, self.goal = texts, k, goal
        self.embedder = embedder or HashedBowEmbedder()
        self.scorer = scorer or TokenScorer()
        self.proposer = proposer or TokenProposer()
        self.committer = committer or FirstMatchCommitter()
        self.judge, self.reference = judge, reference
        self.verdicts, self.vectors = verdicts, vectors
        self.temperature, self.screen, self.rounds, self.explore = temperature, screen, rounds, explore
        self.random_update, self.max_tokens, self.binary = random_update, max_tokens, binary
        self.gain, self.seed = gain, seed
        if self.verdicts is None and not self.scorer.native:
            self.verdicts = VerdictCache(self.spark, f"{shared_folder(self.spark)}/traitscope/verdicts-{uuid.uuid4().hex}")
        self.pool: dict[str, np.ndarray] = {}
        self.inferences = 0
        self.bound: np.ndarray | None = None  # largest score per predicate, where scores are not 0/1

    # --- what a problem defines ---------------------------------------------------------

    def with_target(self, texts: DataFrame) -> DataFrame:
        """``texts`` with the whole number ``y`` that the problem compares to (0 if none)."""
        return texts.withColumn("y", F.lit(0))

    def directions_solver(self, ks: list[int], begin: np.ndarray | None):
        """A solver (see ``operators.passes``), or a ``Search`` that starts one, for the directions of ``ks``."""
        raise NotImplementedError

    def losses(self, table: DataFrame, k: int) -> dict[int, float]:
        """Fitness by ``variant`` of a pattern table (variant, phi, y, cnt)."""
        raise NotImplementedError

    # --- tables -------------------------------------------------------------------------

    def prepare(self) -> None:
        # The one copy of the texts that a fit writes; deduplication and embedding run into it.
        rows = self.texts
        embedded = self.vectors.embed(rows, self.embedder) if self.vectors is not None else self.embedder.embed(rows)
        if not isinstance(self.embedder, HashedBowEmbedder):
            unit = F.transform(l2_normalize("embedding"), lambda x: F.coalesce(x, F.lit(0.0)).cast("float"))
            embedded = embedded.withColumn("embedding", unit)
        self.base = self.with_target(materialise(embedded, "base"))
        self.n = count_rows(self.base)
        if self.n == 0:
            raise ValueError("there are no texts to explain")
        sample = screen_sample(self.base, self.screen, self.seed, total=self.n)
        # A shuffle of at most ``screen`` rows; coalesce would pull the scan of the corpus into one task.
        self.sampled = materialise(sample.repartition(1), "screen")
        held = self.sampled.select("text_id", "embedding").orderBy("text_id").collect()  # at most ``screen`` rows
        self.sample_vectors = np.array([r["embedding"] for r in held], dtype=float)
        picked = geometry.kmeanspp_seed(self.base, self.k, self.seed).orderBy("step").collect()
        self.seeds = solvers.unit(np.array([r["embedding"] for r in picked], dtype=float))

    def denotation(self, predicates: Sequence[str]) -> DataFrame:
        return denote(self.base, predicates, self.scorer, self.verdicts, self.max_tokens)

    def count_inferences(self, texts: DataFrame, predicates: Sequence[str], rows: int) -> None:
        """Add the verdicts that scoring would compute: pairs for a native scorer, misses of the cache else."""
        if self.scorer.native:
            self.inferences += rows * len(predicates)
        else:
            self.inferences += inference_count(texts, predicates, self.scorer, self.verdicts).first()[0]

    def set_predicates(self, predicates: list[str]) -> None:
        self.predicates = list(predicates)
        self.count_inferences(self.base, predicates, self.n)
        if self.scorer.native:
            wide = self.base.select(
                "text_id", "y", "embedding", phi_column("text", predicates, self.scorer).alias("phi")
            )
        else:
            den = self.denotation(predicates)
            wide = self.base.select("text_id", "y", "embedding").join(den, "text_id")
        # Earlier states stay: the trajectory reads them.
        self.state = materialise(wide, "state")
        if not self.binary:
            sizes = [F.max(F.abs(F.get("phi", F.lit(i)).cast("double"))).alias(f"m{i}") for i in range(self.k)]
            self.bound = np.array([v or 0.0 for v in self.state.agg(*sizes).first()])

    def grouped(self, wide: DataFrame, k: int) -> DataFrame:
        """Pattern counts per target value, written once: everything else reads this small table."""
        return materialise(patterns.pattern_counts(wide, k, "y", binary=self.binary), "patterns")

    # --- search -------------------------------------------------------------------------

    def direction_score(self, direction: np.ndarray) -> Column:
        """embedding . direction as a column expression: no text passes through Python."""
        weights = F.array(*[F.lit(float(v)) for v in direction])
        products = F.zip_with("embedding", weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    def proposals(self, directions: Sequence[np.ndarray]) -> Iterator[list[str]]:
        """Proposals for each direction, in order; a built-in proposer scans the texts once for all."""
        names = [f"target{i}" for i in range(len(directions))]
        targets = [self.direction_score(d).alias(name) for d, name in zip(directions, names)]
        scored = self.base.select("text_id", "text", *targets)
        for proposal in self.proposer.propose_many(scored, names, self.goal):
            yield proposal.descriptions

    def add(self, descriptions: Sequence[str]) -> None:
        """Score new predicates on the screened sample (at most ``screen`` texts)."""
        new = [d for d in dict.fromkeys(descriptions) if d not in self.pool]
        if not new:
            return
        self.count_inferences(self.sampled, new, len(self.sample_vectors))
        den = denote(self.sampled, new, self.scorer, self.verdicts, self.max_tokens)
        held = np.array([r["phi"] for r in den.orderBy("text_id").collect()], dtype=float)
        for i, d in enumerate(new):
            self.pool[d] = held[:, i]

    def ranked(self, direction: np.ndarray) -> list[str]:
        """The pool by falling correlation with the direction on the sample; ties by age."""
        if not self.pool:
            raise ValueError("the proposer returned no predicate")
        names = list(self.pool)
        if self.random_update:
            rng = np.random.default_rng([self.seed, len(names)])
            return [names[i] for i in rng.permutation(len(names))]
        y = self.sample_vectors @ direction
        y = y - y.mean()
        bits = np.array([self.pool[p] for p in names])
        bits = bits - bits.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(bits, axis=1) * np.linalg.norm(y)
        r = np.divide(bits @ y, norm, out=np.zeros(len(names)), where=norm > 1e-12)
        r = np.round(np.abs(r) if self.absolute else r, 9)
        return [names[i] for i in sorted(range(len(names)), key=lambda i: (-r[i], i))]

    def fit(self) -> Explanation:
        self.prepare()
        blank = self.base.select("y", "embedding", F.array(*[F.lit(0)] * self.k).alias("phi"))
        (directions,) = solve(Passes(blank, self.n), [self.directions_solver(list(range(self.k)), self.seeds)])
        for descriptions in self.proposals(directions):
            self.add(descriptions)
        self.set_predicates([self.ranked(d)[0] for d in directions])
        table = self.grouped(self.state, self.k)
        loss = self.losses(table.withColumn("variant", F.lit(0)), self.k)[0]
        trajectory = [Step("init", self.evaluate(loss))]
        for round_ in range(self.rounds):
            order = self.by_uselessness(table, loss)
            asked = [self.directions_solver([k], None) for k in order]
            found = dict(zip(order, solve(Passes(self.state.select("y", "embedding", "phi"), self.n), asked)))
            best = None
            for k, descriptions in zip(order, self.proposals([found[k][0] for k in order])):
                direction = found[k][0]
                self.add(descriptions)
                candidates = self.ranked(direction)[: self.explore]
                results = self.candidate_results(k, candidates)
                j = min(results, key=lambda i: (results[i], i))
                if results[j] < loss:
                    best = (k, candidates[j])
                    break
            if best is None:
                break
            predicates = list(self.predicates)
            predicates[best[0]] = best[1]
            self.set_predicates(predicates)
            table = self.grouped(self.state, self.k)
            loss = self.losses(table.withColumn("variant", F.lit(0)), self.k)[0]
            trajectory.append(Step(f"iteration_{round_}", self.evaluate(loss)))
        last = trajectory[-1].evaluation
        return Explanation(
            last.predicates,
            last.after if self.commits else last.before,
            last.loss,
            trajectory,
            last.aligned,
            last.metrics.get("surface_similarity"),
            last.metrics.get("main_f1"),
        )

    def by_uselessness(self, table: DataFrame, loss: float) -> list[int]:
        """Predicates by the loss their removal costs, those with an equal twin first."""
        variants = patterns.ablated(table, self.k, "y").filter("variant >= 0")
        without = self.losses(variants, self.k)
        twin = {r["predicate_id"]: r["has_twin"] for r in patterns.duplicate_predicates(table, self.k).collect()}
        return sorted(range(self.k), key=lambda k: (float("-inf") if twin[k] else round(without[k] - loss, 12), k))

    def candidate_results(self, slot: int, candidates: list[str]) -> dict[int, float]:
        """Fitness with each candidate in ``slot``: all candidates in one scan of the texts."""
        self.count_inferences(self.base, candidates, self.n)
        if self.scorer.native:
            phi = phi_column("text", [*self.predicates, *candidates], self.scorer)
            wide = self.base.select("y", phi.alias("phi"))
        else:
            den = self.denotation(candidates).withColumnRenamed("phi", "extra")
            held = self.state.select("text_id", "y", F.col("phi").cast("array<double>").alias("phi"))
            joined = held.join(den, "text_id")
            wide = joined.select("y", F.concat("phi", F.col("extra").cast("array<double>")).alias("phi"))
        table = self.grouped(wide, self.k + len(candidates))
        return self.losses(patterns.swapped(table, self.k, slot, len(candidates), "y"), self.k)

    # --- evaluation ---------------------------------------------------------------------

    def evaluate(self, loss: float) -> Evaluation:
        """The current predicates, committed where the model commits, and against the reference if there is one."""
        before = self.state.select("text_id", "phi")
        result = Evaluation(list(self.predicates), loss, before)
        metrics = result.metrics
        final = before
        if self.commits:
            final = result.after = self.committed()
        if self.reference is not None:
            gold = self.reference.denotation
            f1s = agreement.pairwise_f1(agreement.paired_patterns(agreement.paired(gold, before)))
            metrics["before_f1"] = metrics["main_f1"] = agreement.mean_best_f1(f1s).first()[0]
            # K x K rows and K rows.
            result.details += [{"measure": "f1", "value": r["f1"], **ids(r)} for r in f1s.orderBy("ref_id", "pred_id").collect()]
            if self.commits:
                each = materialise(agreement.matched_metrics(agreement.paired(gold, final), self.k), "matched")
                for r in each.orderBy("ref_id").collect():
                    measured = ("cosine", "auc", "f1", "precision", "recall", "size")
                    result.details += [{"measure": f"matched_{m}", "value": r[m], **ids(r)} for m in measured]
                matched = agreement.matched_means(each).first()
                metrics.update(main_f1=matched["mean_f1"], after_cosine=matched["mean_cosine"], after_auc=matched["mean_auc"])
            if self.reference.predicates is not None:
                f1s = agreement.pairwise_f1(agreement.paired_patterns(agreement.paired(gold, final)))
                best = agreement.best_matches(f1s).orderBy("ref_id").collect()  # K rows
                result.aligned = [self.predicates[r["pred_id"]] for r in best]
                pairs = self.spark.createDataFrame(list(zip(self.reference.predicates, result.aligned)), "a string, b string")
                judged = agreement.surface_similarity(pairs, "a", "b", self.judge).collect()  # K rows
                metrics["surface_similarity"] = float(np.mean([r["similarity"] for r in judged]))
                told = {(r["a"], r["b"]): r["similarity"] for r in judged}
                for r, a, b in zip(best, self.reference.predicates, result.aligned):
                    result.details.append({"measure": "similarity", "value": told[a, b], **ids(r)})
        metrics["inferences"] = self.inferences
        return result

    def committed(self) -> DataFrame:
        """(text_id, phi) with each text forced to its best predicate."""
        chosen = self.committer.commit(self.base.select("text_id", "text"), self.predicates)
        return materialise(chosen.select("text_id", "phi"), "committed")

    # --- pattern tables -----------------------------------------------------------------

    def sources(self, table: DataFrame, k: int) -> dict[int, Held | Passes]:
        """Per variant, the (phi, cnt) rows as a source of sums."""
        merged = table.groupBy("variant", "phi").agg(F.sum("cnt").alias("weight"))
        return self._gather(merged, k)

    def table_bound(self, table: DataFrame, k: int) -> np.ndarray | None:
        """Largest score per column of a pattern table; None where scores are 0/1."""
        if self.binary:
            return None
        sizes = [F.max(F.abs(F.get("phi", F.lit(i)).cast("double"))) for i in range(k)]
        return np.array([v or 0.0 for v in table.agg(*sizes).first()])

    def _gather(self, merged: DataFrame, k: int) -> dict[int, Held | Passes]:
        if self.binary and k <= HELD_BITS:
            rows = merged.toPandas()
            out: dict[int, Held | Passes] = {}
            for variant, part in rows.groupby("variant"):
                y = part["y"].to_numpy(np.int64) if "y" in part else np.zeros(len(part), np.int64)
                phi = np.array([list(p) for p in part["phi"]], dtype=float)
                out[int(variant)] = Held(Rows(np.zeros((len(part), 0)), phi, y, part["weight"].to_numpy(float)))
            return out
        kept = materialise(merged, "patterns")
        ids = [r["variant"] for r in kept.select("variant").distinct().collect()]
        return {i: Passes(kept.filter(F.col("variant") == i)) for i in ids}


class ClusteringModel(Model):
    """Which K predicates best partition the texts?"""

    commits = True

    def __init__(self, texts: DataFrame, k: int, goal: str | None = None, smoothing: float = 1.0, **options):
        super().__init__(texts, k, goal, **options)
        self.smoothing = smoothing

    def directions_solver(self, ks: list[int], begin: np.ndarray | None):
        return LightSearch(solvers.cluster_directions, self.k, ks, self.seeds, begin, self.n, self.smoothing, self.temperature, self.gain, self.bound)

    def losses(self, table: DataFrame, k: int) -> dict[int, float]:
        result = patterns.cluster_fitness(table, k, self.smoothing, ["variant"])
        return {r["variant"]: r["loss"] for r in result.collect()}


class ClassificationModel(Model):
    """Which K predicates predict a label? ``texts`` has ``label``; any whole numbers will do."""

    absolute = True

    def with_target(self, texts: DataFrame) -> DataFrame:
        # One row per class.
        self.classes = sorted(r["label"] for r in texts.select("label").distinct().collect())
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("label")) - 1
        return texts.withColumn("y", place.cast("int"))

    def directions_solver(self, ks: list[int], begin: np.ndarray | None):
        return Search(solvers.class_directions, self.k, ks, self.seeds, begin, self.n, len(self.classes), self.gain)

    def losses(self, table: DataFrame, k: int) -> dict[int, float]:
        merged = table.groupBy("variant", "phi", "y").agg(F.sum("cnt").alias("weight"))
        out = {}
        for variant, source in self._gather(merged, k).items():
            ((_, loss),) = solve(source, [solvers.label_weights(k, len(self.classes), float(self.n))])
            out[variant] = loss
        return out


class TimeSeriesModel(Model):
    """Which K predicates drift over time? ``texts`` has ``t``, the 0-based place in time.

    There is one weight vector per place. Scores that are not 0/1 (``binary=False``) leave no small
    pattern table, so their places share weights in ``knots`` buckets of neighbours, and so do the
    directions' searches, whose scores are real numbers: a softmax over all texts for every place
    would be a product of both. ``buckets`` asks for shared weights everywhere.
    """

    absolute = True

    def __init__(
        self,
        texts: DataFrame,
        k: int,
        goal: str | None = None,
        discontinuity_penalty: float = 1.0,
        buckets: int | None = None,
        knots: int = 512,
        **options,
    ):
        super().__init__(texts, k, goal, **options)
        self.penalty, self.max_buckets = discontinuity_penalty, buckets or knots
        self.each = buckets is None and self.binary

    def with_target(self, texts: DataFrame) -> DataFrame:
        self.length = int(texts.agg(F.max("t")).first()[0]) + 1
        self.buckets = min(self.length, self.max_buckets)
        shared = F.floor(F.col("t") * F.lit(self.buckets) / F.lit(self.length)).cast("int")
        return texts.withColumn("y", F.col("t").cast("long") if self.each else shared)

    def directions_solver(self, ks: list[int], begin: np.ndarray | None):
        places = self.length if self.each else self.buckets
        return Search(solvers.series_directions, self.k, ks, self.seeds, begin, self.buckets, self.penalty, self.gain, self.bound, places)

    def weights(self) -> DataFrame:
        """(t, w): the weights of every place (or bucket) under the current predicates."""
        table = self.grouped(self.state, self.k).withColumn("variant", F.lit(0))
        if self.each:
            return path_weights(series_path(table, self.k, self.penalty, self.length)[0], self.spark)
        _, w = self.bucket_losses(table, self.k)[0]
        return self.spark.createDataFrame([(t, [float(v) for v in row]) for t, row in enumerate(w)], "t bigint, w array<double>")

    def losses(self, table: DataFrame, k: int) -> dict[int, float]:
        if self.each:
            runs, losses = series_path(table, k, self.penalty, self.length)
            runs.drop()
            return losses
        return {variant: loss for variant, (loss, _) in self.bucket_losses(table, k).items()}

    def bucket_losses(self, table: DataFrame, k: int) -> dict[int, tuple[float, np.ndarray]]:
        out = {}
        per_bucket = (
            table.groupBy("variant", "y")
            .agg(
                F.sum("cnt").alias("n"),
                *[F.sum(F.get("phi", F.lit(i)).cast("double") * F.col("cnt")).alias(f"s{i}") for i in range(k)],
            )
            .toPandas()
        )
        for variant, source in self.sources(table, k).items():
            part = per_bucket[per_bucket["variant"] == variant]
            sizes, sums = np.zeros(self.buckets), np.zeros((self.buckets, k))
            at = part["y"].to_numpy(np.int64)
            sizes[at] = part["n"]
            sums[at] = part[[f"s{i}" for i in range(k)]].to_numpy(float)
            ((w, loss),) = solve(source, [solvers.series_weights(k, sizes, sums, self.penalty, bound=self.table_bound(table, k))])
            out[variant] = (loss, w)
        return out
