"""Every operator as a query over the test tables: name -> fn(spark, folder) -> DataFrame."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscope import explain_clusters, explain_labels, explain_trend
from traitscope.functions import prompts, text, vectors
from traitscope.operators import agreement, denote, embedders, geometry, ordered, patterns, proposers, sampling, scorers, texts
from traitscope.operators.passes import Passes, solve
from traitscope.plans import solvers
from traitscope.plans.explain import classification_weights, series_texts
from traitscope.plans.models import ClusteringModel, Model, Reference
from traitscope.plans.series import path_weights, series_path
from traitscope.session import materialise, shared_folder, ship_package
from traitscope.sources import problems, results
from traitscope.sources.caches import EmbeddingCache, VerdictCache

PREDICATES = ["the", "und", "el", "le"]
CANDIDATES = ["of", "die", "la", "que", "and"]
LANGS = ["en", "de", "es", "fr"]
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        ship_package(spark, os.path.dirname(os.path.abspath(__file__)))
        return fn(spark, folder)

    REGISTRY[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return problems.load_texts(table(spark, folder, "documents"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return problems.load_labelled(table(spark, folder, "documents"), table(spark, folder, "labels"), label="quality")


def den(spark: SparkSession, folder: str, predicates=PREDICATES) -> DataFrame:
    return denote.distinct_denotation(docs(spark, folder), predicates)


def labelled_den(spark: SparkSession, folder: str, predicates=PREDICATES) -> DataFrame:
    return labelled(spark, folder).select(
        "text_id", "label", denote.phi_column("text", predicates, scorers.TokenScorer()).alias("phi")
    )


def lang_reference(spark: SparkSession, folder: str) -> DataFrame:
    bits = [(F.col("lang") == x).cast("int") for x in LANGS]
    return table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), F.array(*bits).alias("phi"))


def all_den(spark: SparkSession, folder: str, predicates=PREDICATES) -> DataFrame:
    return denote.denote(docs(spark, folder), predicates)


def vecs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "text_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    x = F.array((F.col("event_type") == "error").cast("double"), (F.col("event_type") == "view").cast("double"))
    return e.select("event_id", "ts", x.alias("x"))


def bits(k: int, prefix: str = "p") -> list[Column]:
    return [F.get("phi", F.lit(i)).cast("int").alias(f"{prefix}{i}") for i in range(k)]


def r9(c: Column | str) -> Column:
    return F.round(c, 9)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/traitscope/{name}-{uuid.uuid4().hex}"


def token_pairs(batch: list) -> list[float]:
    return [1.0 if h in t.split() else 0.0 for h, t in batch]


# --- sources and sinks ----------------------------------------------------------------


@query
def load_problem(spark, folder):
    """Each document as a problem in a file: its lines are the parallel array of texts."""
    lines = F.split("text", "\n")
    raw = table(spark, folder, "documents").select(
        "doc_id",
        lines.alias("texts"),
        F.lit(None).cast("array<string>").alias("texts_by_time"),
        F.transform(lines, lambda x: F.length(x) % 2).alias("labels"),
        F.transform(lines, lambda x: F.array((F.length(x) % 3).cast("double"))).alias("reference_phi_denotation"),
    )
    path = scratch(spark, "problems")
    raw.drop("doc_id").write.json(path)
    rows, _ = problems.load_problem(spark, path)
    return rows.groupBy("position").agg(
        F.count("*").alias("n"),
        F.sum("label").alias("labels"),
        F.sum(F.get("reference", F.lit(0)).cast("bigint")).alias("reference"),
    )


@query
def load_texts(spark, folder):
    return docs(spark, folder).select("text_id", F.md5("text").alias("text_md5"))


@query
def load_labelled(spark, folder):
    return labelled(spark, folder).select("text_id", "label", F.md5("text").alias("text_md5"))


@query
def write_result(spark, folder):
    path = scratch(spark, "result")
    long = denote.to_long(den(spark, folder))
    results.write_result(long, path, "first")
    return spark.read.parquet(path).groupBy("run_id", "predicate_id").agg(
        F.count("*").alias("n"), F.sum("value").cast("bigint").alias("matches")
    )


@query
def embedding_cache(spark, folder):
    """German and French texts are embedded first, then all: only the others are missing."""
    cache = EmbeddingCache(spark, scratch(spark, "vectors"))
    model = embedders.HashedBowEmbedder()
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    cache.embed(d.filter(F.col("lang").isin("de", "fr")).drop("lang"), model)
    out = cache.embed(d.drop("lang"), model)
    stored = cache.read(model.name).agg(F.count("*").alias("stored")).scalar()
    values = [F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"e{i}") for i in range(50)]
    return out.select("text_id", *values, stored.alias("stored"))


@query
def verdict_cache(spark, folder):
    """A batch function with a cache that already knows the English texts."""
    cache = VerdictCache(spark, scratch(spark, "verdicts"))
    scorer = scorers.BatchScorer(token_pairs, "tokens")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    denote.denote(d.filter("lang = 'en'"), PREDICATES, scorer, cache)
    return denote.denote(d, PREDICATES, scorer, cache).select("text_id", *bits(4))


@query
def seed_verdicts(spark, folder):
    """Known verdicts for German texts win over what the scorer would say."""
    cache = VerdictCache(spark, scratch(spark, "verdicts"))
    scorer = scorers.BatchScorer(token_pairs, "tokens")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    known = d.filter("lang = 'de'").select("text", F.lit("the").alias("predicate"), F.lit(1.0).alias("value"))
    cache.seed(known, scorer.name)
    return denote.denote(d, ["the", "und"], scorer, cache).select("text_id", *bits(2))


def run_log(spark, folder):
    d = table(spark, folder, "documents")
    tag = F.element_at(F.array(*[F.lit(t) for t in results.TAGS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        F.concat(F.lit("run"), F.col("doc_id").cast("string")).alias("run_id"),
        F.col("lang").alias("problem_type"),
        F.when(F.col("source") == "src0", "dummy").otherwise(F.col("source")).alias("dataset"),
        (F.col("doc_id") % 11 % 7).cast("int").alias("seed"),
        tag.alias("tag"),
        ((F.col("n_chars") % 1000) / 1000.0).alias("main_f1"),
        F.timestamp_seconds(F.lit(1704153600) - F.col("doc_id") % 60 * 3600).alias("started"),
        (F.col("n_chars") % 3 == 0).alias("finished"),
    )


@query
def pending_runs(spark, folder):
    log = run_log(spark, folder)
    sets = log.select("problem_type", "dataset").distinct()
    return results.pending_runs(results.run_grid(sets, 7), log, F.timestamp_seconds(F.lit(1704153600)))


@query
def load_results(spark, folder):
    return results.real_results(run_log(spark, folder)).select("run_id", "problem_type", "dataset", "seed", "tag", r9("main_f1").alias("main_f1"))


@query
def summarize_performance(spark, folder):
    rows = results.summarize_performance(results.real_results(run_log(spark, folder)))
    return rows.select("problem_type", "dataset", *[r9(t).alias(t) for t in results.TAGS])


@query
def trajectory_scores(spark, folder):
    """First and last step of each run; a conversation is a run, its turns are the steps."""
    c = table(spark, folder, "conversations")
    steps = c.select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.lit("cluster").alias("problem_type"),
        F.lit("turns").alias("dataset"),
        F.lit(0).alias("seed"),
        F.lit("normal").alias("tag"),
        F.col("turn").alias("step"),
        (F.length("text") / 1000.0).alias("main_f1"),
    )
    return results.trajectory_scores(steps).select("run_id", "tag", r9("main_f1").alias("main_f1"))


# --- scalars --------------------------------------------------------------------------


@query
def token_predicate(spark, folder):
    return all_den(spark, folder).select("text_id", *bits(4))


@query
def denote_pairs(spark, folder):
    """The i-th text against the i-th predicate: the article of the text's own language."""
    d = table(spark, folder, "documents")
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in zip(LANGS, PREDICATES) for x in p]), F.col("lang")), F.lit("the"))
    pairs = d.select(F.col("doc_id").alias("text_id"), "text", own.alias("predicate"))
    return denote.denote_pairs(pairs).select("text_id", "predicate", F.col("value").cast("int").alias("value"))


@query
def first_match_assign(spark, folder):
    return docs(spark, folder).select("text_id", text.first_match("text", PREDICATES).alias("choice"))


@query
def render_validator_prompt(spark, folder):
    prompt = prompts.validator_prompt(F.lit("mentions {text} and the weather"), "text")
    return docs(spark, folder).select("text_id", F.md5(prompt).alias("prompt_md5"))


@query
def render_assign_prompt(spark, folder):
    listed = F.array(*[F.lit(p) for p in PREDICATES])
    prompt = prompts.assign_prompt(listed, "text", add_null=True)
    return docs(spark, folder).select("text_id", F.md5(prompt).alias("prompt_md5"))


@query
def parse_yes_no(spark, folder):
    return docs(spark, folder).select("text_id", text.parse_yes_no("text").alias("value"))


def assignment_response() -> Column:
    i = F.col("text_id")
    return (
        F.when(i % 7 == 0, F.lit(""))
        .when(i % 7 == 1, F.concat(F.lit("none ]["), i.cast("string"), F.lit("]")))
        .when(i % 7 == 2, F.concat(F.lit("["), (i % 5).cast("string"), F.lit(", x]")))
        .when(i % 7 == 3, F.concat(F.lit("the answer is ["), (i % 6).cast("string"), F.lit(", "), (i % 3).cast("string"), F.lit("] I think [0]")))
        .when(i % 7 == 4, F.concat(F.lit("["), (i % 4).cast("string"), F.lit(".7]")))
        .when(i % 7 == 5, F.concat(F.lit('["'), (i % 4).cast("string"), F.lit('"]')))
        .otherwise(F.concat(F.lit("["), (-(i % 6)).cast("string"), F.lit("]")))
    )


@query
def parse_assignment(spark, folder):
    d = docs(spark, folder).select("text_id", text.parse_assignment(assignment_response(), 4).alias("phi"))
    return d.select("text_id", *bits(4))


@query
def parse_proposals(spark, folder):
    """Each document as an answer: its lines as quoted bullets."""
    answer = F.concat(F.lit('- "'), F.replace(F.col("text"), F.lit("\n"), F.lit('"\n- "')), F.lit('"'))
    d = docs(spark, folder).select("text_id", F.explode(text.parse_proposals(answer)).alias("description"))
    return d.select("text_id", F.md5("description").alias("description_md5"))


@query
def drop_refusals(spark, folder):
    i = F.col("text_id")
    answer = (
        F.when(i % 5 == 0, F.concat(F.lit("I Apologize, "), "text"))
        .when(i % 7 == 0, F.lit(None).cast("string"))
        .when(i % 11 == 0, F.concat("text", F.lit(" there is not ENOUGH information")))
        .otherwise(F.col("text"))
    )
    return docs(spark, folder).filter(~text.is_refusal(answer)).select("text_id")


@query
def truncate_tokens(spark, folder):
    return docs(spark, folder).select("text_id", F.md5(text.truncate_tokens("text", 256)).alias("text_md5"))


@query
def strip_double_newlines(spark, folder):
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n\n"))
    return docs(spark, folder).select("text_id", F.md5(text.strip_double_newlines(doubled)).alias("text_md5"))


@query
def parse_similarity(spark, folder):
    d = docs(spark, folder)
    answer = F.when(F.col("text_id") % 9 != 0, F.col("text"))
    return d.select("text_id", text.parse_similarity(answer).alias("value"))


@query
def is_null_description(spark, folder):
    p = table(spark, folder, "part")
    words = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.is_null_description(words).alias("is_null"))


@query
def l2_normalize(spark, folder):
    v = vecs(spark, folder)
    scaled = v.select("text_id", F.transform("embedding", lambda x: x * (F.col("text_id") % 5)).alias("embedding"))
    unit = scaled.select("text_id", vectors.l2_normalize("embedding").alias("u"))
    return unit.select("text_id", F.posexplode("u").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query
def hashed_bow_embed(spark, folder):
    e = embedders.HashedBowEmbedder().embed(docs(spark, folder))
    return e.select("text_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(f"e{i}") for i in range(50)])


@query
def random_project(spark, folder):
    e = embedders.random_project(vecs(spark, folder).select("text_id", "embedding"), 3, 64)
    return e.select("text_id", *[F.round(F.get("projected", F.lit(i)), 6).alias(f"e{i}") for i in range(3)])


@query
def one_hot_embed(spark, folder):
    e = embedders.one_hot_embed(texts.dedup_texts(docs(spark, folder)))
    return e.select("text_id", "index", "size", F.col("value").cast("int").alias("value"))


@query
def turn_features(spark, folder):
    """Feature columns for every turn, looked up by the text's id."""
    c = table(spark, folder, "conversations")
    rows = c.withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    distinct = texts.dedup_texts(rows)
    d = denote.denote(distinct, PREDICATES)
    ids = distinct.select(texts.text_key("text").alias("text_key"), "text_id")
    placed = texts.scatter_back(rows.select("conv_id", "turn", "text"), ids).select("conv_id", "turn", "text_id")
    return patterns.feature_rows(d, placed, PREDICATES).select("conv_id", "turn", *[f"f{i}" for i in range(4)])


@query
def expand_taxonomy(spark, folder):
    """Brands as top predicates, their part types as sub-predicates."""
    p = table(spark, folder, "part")
    tops = patterns.small_rank(p.select("p_brand").distinct(), ["p_brand"], "place")
    kids = p.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("children"))
    taxonomy = tops.join(kids, "p_brand").select("place", F.col("p_brand").alias("predicate"), "children")
    return results.expand_taxonomy(taxonomy)


@query
def log_softmax(spark, folder):
    v = vecs(spark, folder).select("text_id", F.posexplode(vectors.log_softmax("embedding", 0.1)).alias("dim", "value"))
    return v.withColumn("value", F.round("value", 6))


@query
def floor_prob(spark, folder):
    v = vecs(spark, folder)
    n = v.agg(F.count("*").alias("n")).scalar()
    entries = v.select("text_id", F.posexplode("embedding").alias("dim", "x"))
    p = F.exp(F.col("x").cast("double")) / n
    return entries.select("text_id", "dim", r9(-F.ln(vectors.floor_prob(p, 1.0, n))).alias("nll"))


# --- joins ----------------------------------------------------------------------------


@query
def denote_distinct(spark, folder):
    return den(spark, folder).select("text_id", *bits(4))


@query
def denote_long(spark, folder):
    return denote.to_long(den(spark, folder)).select("text_id", "predicate_id", F.col("value").cast("int").alias("value"))


@query
def scatter_back(spark, folder):
    d = docs(spark, folder)
    scored = texts.dedup_texts(d).select(texts.text_key("text").alias("text_key"), F.col("text_id").alias("first_id"))
    return texts.scatter_back(d, scored).select("text_id", "first_id")


@query
def cache_misses(spark, folder):
    """Pairs of distinct texts and predicates for which German texts already have a verdict."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text", "lang")
    key = texts.text_key("text").alias("text_key")
    known = d.filter("lang = 'de'").select(key, F.explode(F.array(F.lit("the"), F.lit("und"))).alias("predicate"))
    distinct = texts.dedup_texts(d).withColumn("text_key", key)
    misses = denote.missing_pairs(distinct, PREDICATES, known.withColumn("value", F.lit(0.0)))
    return misses.select(F.lower(F.hex("text_key")).alias("text_md5"), "predicate")


@query
def new_predicates(spark, folder):
    d = table(spark, folder, "documents")
    words = d.select("lang", F.explode(text.tokens("text")).alias("predicate"))
    return denote.new_predicates(words.filter("lang <> 'en'"), words.filter("lang = 'en'").distinct())


@query
def token_matches(spark, folder):
    """All words as a predicate table, matched by an equi-join."""
    d = docs(spark, folder)
    words = d.select(F.explode(text.tokens("text")).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("n"))
    named = words.select(F.col("predicate").alias("predicate_id"), "predicate")
    return denote.token_matches(d, named).groupBy("predicate_id").agg(F.count("*").alias("matches"))


@query
def duplicate_predicates(spark, folder):
    p = ["the", "und", "the", "zzzz", "qqqq"]
    d = den(spark, folder, p)
    return patterns.duplicate_predicates(patterns.pattern_counts(d, 5), 5)


@query
def screen_sample(spark, folder):
    return sampling.screen_sample(docs(spark, folder), 256, seed=1).select("text_id", F.md5("text").alias("text_md5"))


# --- statistics -----------------------------------------------------------------------


@query
def predicate_counts(spark, folder):
    long = denote.to_long(den(spark, folder))
    names = F.element_at(F.array(*[F.lit(p) for p in PREDICATES]), F.col("predicate_id") + 1)
    return long.groupBy("predicate_id", names.alias("predicate")).agg(
        F.count("*").alias("n_texts"), F.sum("value").cast("bigint").alias("matches")
    )


@query
def predicate_report(spark, folder):
    report = patterns.predicate_report(den(spark, folder), docs(spark, folder), PREDICATES)
    return report.select("predicate_id", "predicate", "matches", F.md5(F.array_join("sample", "|")).alias("sample_md5"))


@query
def predicate_correlation(spark, folder):
    c = patterns.predicate_correlation(labelled_den(spark, folder, PREDICATES + ["zzzz"]), 5, "label")
    return c.select("predicate_id", r9("correlation").alias("correlation"))


@query
def rank_candidates(spark, folder):
    c = patterns.predicate_correlation(labelled_den(spark, folder, PREDICATES + CANDIDATES), 9, "label", absolute=True)
    return patterns.rank_candidates(c).select("predicate_id", "place", r9("correlation").alias("correlation"))


@query
def random_rank(spark, folder):
    words = texts.dedup_by_prefix(table(spark, folder, "part"), "p_type", " ")
    return patterns.random_rank(words.select(F.col("prefix").alias("predicate_id")), 3)


@query
def token_propose(spark, folder):
    p = proposers.token_propose(labelled(spark, folder), "label", 5)
    return p.select("predicate", r9("score").alias("score"))


@query
def token_scores(spark, folder):
    p = proposers.token_scores(labelled(spark, folder), "label")
    return p.select("predicate", F.round("score", 6).alias("score"))


@query
def token_propose_many(spark, folder):
    """Best tokens for two targets at once: the quality label and the length of the text."""
    d = labelled(spark, folder).withColumn("len", F.length("text"))
    return proposers.token_propose_many(d, ["label", "len"], 4)


@query
def distinct_tokens(spark, folder):
    return proposers.distinct_tokens(docs(spark, folder), 25)


@query
def pattern_counts(spark, folder):
    return patterns.pattern_counts(den(spark, folder), 4).select(*bits(4), "cnt")


@query
def label_pattern_counts(spark, folder):
    return patterns.pattern_counts(labelled_den(spark, folder), 4, "label").select(*bits(4), "label", "cnt")


@query
def cluster_fitness(spark, folder):
    p = patterns.pattern_counts(den(spark, folder), 4)
    return patterns.cluster_fitness(p, 4).select("n", r9("loss").alias("loss"))


@query
def ablation_loss(spark, folder):
    p = patterns.pattern_counts(den(spark, folder, PREDICATES + ["und"]), 5)
    out = patterns.ablation_loss(p, 5)
    return out.select("predicate_id", r9("increase").alias("increase"), "has_twin", "place")


@query
def candidate_losses(spark, folder):
    p = patterns.pattern_counts(den(spark, folder, PREDICATES + CANDIDATES), 9)
    out = patterns.candidate_losses(p, 4, 2, 5)
    return out.select("variant", r9("loss").alias("loss"))


@query
def best_candidate(spark, folder):
    p = patterns.pattern_counts(den(spark, folder, PREDICATES + CANDIDATES), 9)
    out = patterns.best_candidate(patterns.candidate_losses(p, 4, 2, 5), 100.0)
    return out.select("variant", r9("loss").alias("loss"))


def lang_pairs(spark, folder):
    return agreement.paired(lang_reference(spark, folder), all_den(spark, folder))


@query
def pairwise_f1(spark, folder):
    f = agreement.pairwise_f1(agreement.paired_patterns(lang_pairs(spark, folder)))
    return f.select("ref_id", "pred_id", r9("f1").alias("f1"))


@query
def best_matches(spark, folder):
    f = agreement.pairwise_f1(agreement.paired_patterns(lang_pairs(spark, folder)))
    return agreement.best_matches(f).select("ref_id", "pred_id", r9("f1").alias("f1"))


@query
def matched_metrics(spark, folder):
    m = agreement.matched_metrics(lang_pairs(spark, folder), 4)
    return m.select("ref_id", "pred_id", *[r9(c).alias(c) for c in ("cosine", "auc", "f1", "precision", "recall", "size")])


@query
def cosine_columns(spark, folder):
    c = agreement.cosine_columns(agreement.paired_patterns(lang_pairs(spark, folder)))
    return c.select("ref_id", "pred_id", r9("cosine").alias("cosine"))


@query
def auc_roc(spark, folder):
    """Length of a text as a score for its quality label."""
    d = labelled(spark, folder).select("label", F.length("text").alias("s"))
    return agreement.auc_roc(d, "label", "s").select(r9("auc").alias("auc"))


@query
def best_threshold_f1(spark, folder):
    d = labelled(spark, folder).select("label", F.length("text").alias("s"))
    return agreement.best_threshold_f1(d, "label", "s").select(r9("best_f1").alias("best_f1"))


def same_start(batch: list) -> list:
    """A stand-in judge that reads the two descriptions back out of its prompt."""
    out = []
    for prompt in batch:
        a, b = (line.split(": ", 1)[1] for line in prompt.splitlines() if line.startswith("text_"))
        out.append("yes" if a.split(" ")[0] == b.split(" ")[0] else "related" if a[0] == b[0] else "no")
    return out


@query
def surface_similarity(spark, folder):
    """Names of parts against their types, judged where both have several words."""
    p = table(spark, folder, "part")
    b = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.substring_index("p_name", " ", 1), F.lit(" "), "p_brand"))
    b = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(b)
    pairs = p.select("p_partkey", F.col("p_name").alias("a"), b.alias("b"))
    judged = agreement.surface_similarity(pairs, "a", "b", scorers.SimilarityJudge(same_start))
    return judged.select("p_partkey", "similarity")


@query
def avg_token_length(spark, folder):
    a = sampling.avg_token_length(docs(spark, folder), 500, seed=2)
    return a.select(
        r9("avg_tokens").alias("avg_tokens"),
        sampling.prompt_budget(F.col("avg_tokens")).alias("budget"),
        sampling.prompt_budget(F.col("avg_tokens"), max_tokens=None, overhead=0).alias("plain_budget"),
    )


@query
def inference_count(spark, folder):
    d = docs(spark, folder)
    cache = VerdictCache(spark, scratch(spark, "verdicts"))
    scorer = scorers.BatchScorer(token_pairs, "tokens")
    cache.seed(d.filter("text_id % 2 = 0").select("text", F.lit("und").alias("predicate"), F.lit(0.0).alias("value")), "tokens")
    native = denote.inference_count(d, PREDICATES, scorers.TokenScorer()).select(F.lit("token").alias("scorer"), "inferences")
    batch = denote.inference_count(d, PREDICATES, scorer, cache).select(F.lit("batch").alias("scorer"), "inferences")
    return native.unionByName(batch)


# --- geometry -------------------------------------------------------------------------


@query
def centroids(spark, folder):
    c = geometry.centroids(vecs(spark, folder), 10, "label")
    return c.select("k", F.posexplode("centroid").alias("dim", "value")).select("k", "dim", F.round("value", 6).alias("value"))


@query
def project_scores(spark, folder):
    v = vecs(spark, folder)
    matrix = geometry.centroid_matrix(v, 10, "label")
    s = geometry.project_scores(v.select("text_id", "embedding"), matrix)
    return s.select("text_id", F.posexplode("scores").alias("k", "score")).select("text_id", "k", F.round("score", 6).alias("score"))


@query
def assign_argmax(spark, folder):
    v = vecs(spark, folder).select("text_id", F.col("embedding").alias("phi"))
    return geometry.assign_argmax(v, 64, 0.1).select("text_id", "cluster")


@query
def kmeanspp_seed(spark, folder):
    s = geometry.kmeanspp_seed(vecs(spark, folder).select("text_id", "embedding"), 3, seed=5)
    return s.select("step", "text_id")


# --- order ----------------------------------------------------------------------------


@query
def number_rows(spark, folder):
    placed, _ = ordered.number_rows(events(spark, folder).select("event_id", "ts"), ["ts", "event_id"])
    return placed.select("event_id", "t")


@query
def time_percentile(spark, folder):
    p = ordered.time_percentile(events(spark, folder).select("event_id", "ts"), ["ts", "event_id"])
    return p.select("event_id", r9("percentile").alias("percentile"))


def curve(spark, folder, seed_n, rate=0.005):
    c = ordered.ema_curve(events(spark, folder), ["ts", "event_id"], "x", rate, seed_n)
    return c.select("event_id", "t", *[r9(F.get("curve", F.lit(i))).alias(f"c{i}") for i in range(2)])


@query
def ema_curve(spark, folder):
    return curve(spark, folder, 50)


@query
def ema_curve_100(spark, folder):
    return curve(spark, folder, 100)


@query
def ema_curve_fast(spark, folder):
    """A rate at which few past values count."""
    return curve(spark, folder, 50, 0.8)


@query
def ema_curve_at_once(spark, folder):
    """A rate of one: the series itself after the seed."""
    return curve(spark, folder, 50, 1.0)


@query
def permutation_band(spark, folder):
    """Bands of 100 shuffles of the smoothed shares of errors and views."""
    c = ordered.ema_curve(events(spark, folder), ["ts", "event_id"], "x", 0.005, 100)
    band = ordered.permutation_band(c.select("t", "curve"))
    return band.select("curve_id", F.round("lower", 7).alias("lower"), F.round("upper", 7).alias("upper"))


@query
def weight_jumps(spark, folder):
    w = vecs(spark, folder).select(F.col("text_id").alias("t"), F.posexplode("embedding").alias("k", "w"))
    jumps = ordered.weight_jumps(w.withColumn("w", F.col("w").cast("double")))
    return jumps.select(r9("mean_squared_jump").alias("mean_squared_jump"))


@query
def prefix_sums(spark, folder):
    counts = labelled(spark, folder).groupBy(F.length("text").alias("len")).agg(F.count("*").alias("c"))
    return ordered.prefix_sums(counts, ["len"], ["c"])


# --- dedup, samples, proposals --------------------------------------------------------


@query
def dedup_texts(spark, folder):
    return texts.dedup_texts(docs(spark, folder)).select("text_id", F.md5("text").alias("text_md5"))


@query
def dedup_keep_first(spark, folder):
    """Distinct texts by first appearance, renumbered."""
    d = docs(spark, folder).withColumnRenamed("text_id", "time")
    return series_texts(d, "time").select("first_at", "t", F.md5("text").alias("text_md5"))


@query
def dedup_last_label(spark, folder):
    d = texts.dedup_last_label(labelled(spark, folder), "text_id", "label")
    return d.select("text_id", "label", F.md5("text").alias("text_md5"))


@query
def dedup_by_prefix(spark, folder):
    return texts.dedup_by_prefix(table(spark, folder, "part"), "p_name", " ")


@query
def extremes_sample(spark, folder):
    d = labelled(spark, folder).select("text_id", F.length("text").alias("target"))
    return sampling.extremes_sample(d, "target", 40, 5, seed=3).select("text_id", "target", "part")


@query
def scored_context(spark, folder):
    d = labelled(spark, folder).select("text_id", "text", (F.length("text") / 7.0).alias("target"))
    chosen = sampling.extremes_sample(d, "target", 40, 5, seed=3)
    lines = proposers.scored_context(chosen, "target")
    prompt = prompts.proposer_prompt(F.col("lines"), "the goal", ["Uses Irony"], 5)
    return lines.select(F.md5(prompt).alias("prompt_md5"))


@query
def uniform_sample(spark, folder):
    return sampling.uniform_sample(docs(spark, folder), 40, seed=9).select("text_id")


@query
def merge_proposals(spark, folder):
    d = table(spark, folder, "documents")
    words = d.select("lang", F.explode(text.tokens("text")).alias("predicate")).groupBy("lang", "predicate").agg(F.count("*").alias("n"))
    pool = words.filter("lang = 'en' and n > 5").select(F.length("predicate").alias("place"), "predicate")
    new = words.filter("lang = 'de' and n > 5").select(F.length("predicate").alias("place"), "predicate")
    return proposers.merge_proposals(pool, new, extra=["is formal", "the"], limit=25)


# --- user functions -------------------------------------------------------------------


def prompt_yes(batch: list) -> list:
    """A stand-in model: says yes if the property is a token of the text, fails on empty texts."""
    out = []
    for prompt in batch:
        hypothesis = prompt.split('PROPERTY: "', 1)[1].split('"\nTEXT: "', 1)[0]
        body = prompt.split('"\nTEXT: "', 1)[1].rsplit('"\nAnswer:', 1)[0]
        out.append("Yes. It does." if hypothesis in body.split() else "No.")
    return out


@query
def prompt_scorer(spark, folder):
    scorer = scorers.PromptScorer(prompt_yes, "stand-in")
    return denote.denote(docs(spark, folder), PREDICATES, scorer).select("text_id", *bits(4))


def pick_index(batch: list) -> list:
    """A stand-in model: answers the first listed description that the text contains."""
    out = []
    for prompt in batch:
        listed, body = prompt.split("DESCRIPTIONS:\n", 1)[1].split("\n\nTEXT:\n", 1)
        body = body.rsplit("\n\nANSWER:", 1)[0]
        hits = [i for i, line in enumerate(listed.splitlines()) if line.split(". ", 1)[1] in body]
        out.append(f"[{hits[0]}]" if hits else "none")
    return out


@query
def prompt_committer(spark, folder):
    c = scorers.PromptCommitter(pick_index).commit(docs(spark, folder), PREDICATES)
    return c.select("text_id", *bits(4))


@query
def commit(spark, folder):
    c = scorers.FirstMatchCommitter().commit(docs(spark, folder), PREDICATES)
    return c.select("text_id", *bits(4))


def letter_counts(batch: list) -> list:
    return [[float(t.count(c)) for c in "aeiou"] for t in batch]


@query
def batch_embedder(spark, folder):
    e = embedders.BatchEmbedder(letter_counts, "vowels").embed(docs(spark, folder))
    return e.select("text_id", *[F.get("embedding", F.lit(i)).cast("int").alias(f"e{i}") for i in range(5)])


def bulleted(batch: list) -> list:
    """A stand-in model: proposes the last words of the best sample as quoted bullets."""
    out = []
    for prompt in batch:
        samples = [line for line in prompt.splitlines() if line.startswith("Sample ")]
        words = samples[-1].split(": ", 1)[1].split(" (score")[0].split()
        out.append(words[0] + '"\n' + "\n".join(f'- "{w}"' for w in words[1:6]))
    return out


@query
def prompt_proposer(spark, folder):
    d = labelled(spark, folder).select("text_id", "text", F.length("text").alias("target"))
    found = proposers.PromptProposer(bulleted).propose(d, "target", "what is long")
    return spark.createDataFrame(list(enumerate(found.descriptions)), "place int, predicate string")


# --- models ---------------------------------------------------------------------------


@query
def class_fitness(spark, folder):
    """Log-loss of the label given the language, in bits that exclude each other."""
    gold = lang_reference(spark, folder)
    counts = patterns.pattern_counts(labelled(spark, folder).select("text_id", "label").join(gold, "text_id"), 4, "label")
    source = Passes(materialise(counts.select("phi", F.col("label").alias("y"), F.col("cnt").alias("weight")), "counts"))
    n = float(counts.agg(F.sum("cnt")).first()[0])
    ((_, loss),) = solve(source, [solvers.label_weights(4, 2, n)])
    return spark.createDataFrame([(int(n), round(loss, 6))], "n bigint, loss double")


def series_patterns(spark, folder) -> tuple[DataFrame, int]:
    """Pattern table of the distinct documents in order, one place for each, and the number of places."""
    t = series_texts(docs(spark, folder).withColumnRenamed("text_id", "time"))
    phi = denote.phi_column("text", PREDICATES, scorers.TokenScorer())
    rows = t.select(F.lit(0).alias("variant"), phi.alias("phi"), F.col("t").alias("y"), F.lit(1).cast("long").alias("cnt"))
    rows = materialise(rows, "series")
    return rows, int(rows.agg(F.max("y")).first()[0]) + 1


@query
def series_fitness(spark, folder):
    """Loss of the series model with a weight vector per document."""
    table, length = series_patterns(spark, folder)
    runs, losses = series_path(table, 4, 1.0, length)
    runs.drop()
    return spark.createDataFrame([(length, losses[0])], "places bigint, loss double")


@query
def series_weights(spark, folder):
    """The weights of every document's place."""
    table, length = series_patterns(spark, folder)
    weights = path_weights(series_path(table, 4, 1.0, length)[0], spark)
    return weights.select("t", F.posexplode("w").alias("k", "w"))


@query
def series_certificate(spark, folder):
    """The gradient of the convex series loss at every weight, from its definition: zero, so the weights are the best."""
    table, length = series_patterns(spark, folder)
    runs, _ = series_path(table, 4, 1.0, length)
    weights = materialise(path_weights(runs, spark), "series-weights")
    runs.drop()
    bits = F.transform("phi", lambda b: b.cast("double"))
    found = table.groupBy("phi").agg(F.sum("cnt").alias("c")).collect()  # at most 2^4 patterns
    ps = F.array(*[F.struct(F.array(*[F.lit(float(b)) for b in r["phi"]]).alias("p"), F.log(F.lit(float(r["c"]))).alias("base")) for r in found])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.transform(ps, lambda q: F.struct(q["p"].alias("p"), F.exp(dot(q["p"], F.col("w")) + q["base"] - F.col("top")).alias("e")))
    wide = weights.withColumn("top", F.array_max(F.transform(ps, lambda q: dot(q["p"], F.col("w")) + q["base"])))
    wide = wide.select("t", "w", e.alias("es"))
    z = F.aggregate("es", F.lit(0.0), lambda s, q: s + q["e"])
    share = lambda k: F.aggregate("es", F.lit(0.0), lambda s, q: s + q["e"] * q["p"][k])
    means = F.array(*[share(k) / z for k in range(4)])
    here = wide.select("t", "w", means.alias("mean")).join(table.select(F.col("y").alias("t"), bits.alias("phi")), "t")
    before = weights.select((F.col("t") + 1).alias("t"), F.col("w").alias("before"))
    after = weights.select((F.col("t") - 1).alias("t"), F.col("w").alias("after"))
    both = here.join(before, "t", "left").join(after, "t", "left")
    jump = lambda k: F.coalesce(F.col("w")[k] - F.col("before")[k], F.lit(0.0)) + F.coalesce(F.col("w")[k] - F.col("after")[k], F.lit(0.0))
    grads = [(F.col("mean")[k] - F.col("phi")[k]) / length + 2.0 / ((length - 1) * 4) * jump(k) for k in range(4)]
    named = both.select("t", F.posexplode(F.array(*grads)).alias("k", "g"))
    return named.select("t", "k", (F.round(F.col("g") * length, 4) + 0.0).alias("gradient"))


def vector_table(spark, folder) -> tuple[DataFrame, np.ndarray, int]:
    v = vecs(spark, folder).select(
        "text_id", "embedding", F.col("label").alias("y"), F.array(*[F.lit(0)] * 3).alias("phi")
    )
    seeds = geometry.kmeanspp_seed(v, 3, seed=1).orderBy("step").collect()
    return v, solvers.unit(np.array([r["embedding"] for r in seeds])), v.count()


def as_rows(spark, matrix) -> DataFrame:
    rows = [(k, d, float(x)) for k, row in enumerate(matrix) for d, x in enumerate(row)]
    return spark.createDataFrame(rows, "k int, dim int, value double")


def label_members(rows):
    return (rows.y[:, None] == np.arange(10)).astype(float), 0.0


@query
def refine_centers(spark, folder):
    """Directions of the ten labelled groups of vectors, refined from their means."""
    v = vecs(spark, folder).select("text_id", "embedding", F.col("label").alias("y"))
    start = geometry.centroid_matrix(v, 10, "y")
    n = v.count()
    solver = solvers.refine_centres(start, label_members, 1.0 / n, 0.1)
    return as_rows(spark, solve(Passes(v), [solver])[0][0])


@query
def cluster_directions(spark, folder):
    v, seeds, n = vector_table(spark, folder)
    return as_rows(spark, solve(Passes(v), [solvers.cluster_directions(3, [0, 1, 2], seeds, seeds, n, 1.0, 0.1)])[0])


@query
def class_directions(spark, folder):
    v, seeds, n = vector_table(spark, folder)
    return as_rows(spark, solve(Passes(v), [solvers.class_directions(3, [0, 1, 2], seeds, seeds, n, 10)])[0])


@query
def series_directions(spark, folder):
    v, seeds, n = vector_table(spark, folder)
    v = v.withColumn("y", F.floor(F.col("text_id") * 20 / F.lit(n)).cast("int"))
    return as_rows(spark, solve(Passes(v), [solvers.series_directions(3, [0, 1, 2], seeds, seeds, 20, 1.0)])[0])


class Covering(Model):
    """A problem of one's own: predicates of which at least one holds for as many texts as possible."""

    def directions_solver(self, ks, begin):
        yield lambda rows: np.array([float(len(rows.y))])
        return begin if begin is not None else self.seeds[ks]

    def losses(self, table, k):
        bare = F.sum(F.when(F.aggregate("phi", F.lit(0), lambda a, x: a + x.cast("int")) == 0, F.col("cnt")).otherwise(0))
        rows = table.groupBy("variant").agg((bare / F.sum("cnt")).alias("loss")).collect()
        return {r["variant"]: float(r["loss"]) for r in rows}


@query
def own_model(spark, folder):
    """Loss of each ablation of four predicates under a model of one's own."""
    model = Covering(texts.dedup_texts(docs(spark, folder)), 4)
    model.prepare()
    model.set_predicates(PREDICATES)
    table = patterns.ablated(model.grouped(model.state, 4), 4, "y")
    rows = [(int(v), float(x)) for v, x in model.losses(table, 4).items()]
    return spark.createDataFrame(rows, "variant int, loss double").withColumn("loss", r9("loss"))


def found(spark, explanation) -> DataFrame:
    rows = [(i, p, explanation.loss) for i, p in enumerate(explanation.predicates)]
    return spark.createDataFrame(rows, "predicate_id int, predicate string, loss double")


@query
def fit_clusters(spark, folder):
    return found(spark, explain_clusters(docs(spark, folder), 3))


@query
def evaluate(spark, folder):
    """Search result against the languages of the texts as the reference."""
    d = materialise(texts.dedup_texts(docs(spark, folder)), "texts")
    gold = Reference(lang_reference(spark, folder), LANGS)
    result = ClusteringModel(d, 4, reference=gold).fit()
    return result.trajectory_table().select("step", "tag", "loss", F.explode("metrics").alias("metric", "value"))


@query
def fit_labels(spark, folder):
    return explain_labels(labelled(spark, folder), 2).weights


@query
def fit_trend(spark, folder):
    rows = docs(spark, folder).withColumnRenamed("text_id", "time")
    return explain_trend(rows, 2).curves.select("time", "t", F.get("curve", F.lit(0)).alias("c0"), F.get("curve", F.lit(1)).alias("c1"))


@query
def classification_weights_of_labels(spark, folder):
    return classification_weights(labelled_den(spark, folder), 4)
