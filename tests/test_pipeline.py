"""Scorers, caches, proposers, sources and whole fits."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitscope import (
    BatchEmbedder,
    BatchScorer,
    ClassificationModel,
    ClusteringModel,
    ColumnEmbedder,
    EmbeddingCache,
    HashedBowEmbedder,
    OneHotEmbedder,
    PromptCommitter,
    PromptProposer,
    PromptScorer,
    Reference,
    SimilarityJudge,
    TimeSeriesModel,
    TokenProposer,
    VerdictCache,
    explain_clusters,
    explain_labels,
    explain_trend,
    run_experiments,
)
from traitscope.operators import agreement, proposers
from traitscope.operators.denote import denote, inference_count
from traitscope.operators.texts import dedup_by_prefix
from traitscope.operators.passes import Passes
from traitscope.plans.explain import classification_weights, series_texts
from traitscope.session import materialise
from traitscope.sources import problems, results

LETTERS = "abcd"


def planted(n=200, order="sorted", seed=1):
    """Texts "a 0.1234...": the first token is one of four signals."""
    rng = np.random.default_rng(seed)
    return [f"{LETTERS[i * 4 // n]} {rng.random():.16f}" for i in range(n)]


def text_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "text_id bigint, text string")


def one_hot(spark, texts):
    rows = [(i, [int(t.split()[0] == c) for c in LETTERS]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "text_id bigint, phi array<int>")


def counting(log):
    def score(batch):
        with open(log, "a") as f:
            f.writelines(json.dumps([h, t]) + "\n" for h, t in batch)
        return [1.0 if h in t.split() else 0.0 for h, t in batch]

    return score


def test_batch_scorer_sees_each_pair_once(spark, tmp_path):
    log = tmp_path / "calls"
    scorer = BatchScorer(counting(str(log)), "counted", batch=2)
    cache = VerdictCache(spark, str(tmp_path / "cache"))
    df = text_frame(spark, ["a b", "a b", "c", "d"]).repartition(3)
    assert inference_count(df, ["a", "c"], scorer, cache).first()[0] == 6
    got = {r["text_id"]: list(r["phi"]) for r in denote(df, ["a", "c"], scorer, cache).collect()}
    assert got == {0: [1, 0], 1: [1, 0], 2: [0, 1], 3: [0, 0]}
    assert len(log.read_text().splitlines()) == 6
    denote(df, ["a", "c", "d"], scorer, cache).collect()
    lines = log.read_text().splitlines()
    assert len(lines) == 9 == len(set(lines))
    assert inference_count(df, ["a", "c", "d"], scorer, cache).first()[0] == 0


def test_known_verdicts_win(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "cache"))
    scorer = BatchScorer(counting(str(tmp_path / "log")), "m")
    df = text_frame(spark, ["a", "b"])
    denote(df, ["a"], scorer, cache).collect()
    cache.seed(spark.createDataFrame([("b", "a", 1.0)], "text string, predicate string, value double"), "m")
    assert sorted(r["phi"][0] for r in denote(df, ["a"], scorer, cache).collect()) == [1.0, 1.0]


def test_failed_call_counts_as_no_and_is_asked_again(spark, tmp_path):
    flag = tmp_path / "up"

    def answer(batch):
        return [("Yes" if "TEXT: \"a" in p else "No") if flag.exists() else None for p in batch]

    cache = VerdictCache(spark, str(tmp_path / "cache"))
    scorer = PromptScorer(answer, "shaky")
    df = text_frame(spark, ["a x", "b x"])
    assert [list(r["phi"]) for r in denote(df, ["p q"], scorer, cache).orderBy("text_id").collect()] == [[0.0], [0.0]]
    flag.write_text("")
    assert [list(r["phi"]) for r in denote(df, ["p q"], scorer, cache).orderBy("text_id").collect()] == [[1.0], [0.0]]


def test_wrong_number_of_scores_is_an_error(spark):
    with pytest.raises(Exception, match="one value per input"):
        denote(text_frame(spark, ["a"]), ["a"], BatchScorer(lambda b: [], "bad")).collect()


def test_embedding_cache_embeds_only_what_is_missing(spark, tmp_path):
    log = tmp_path / "calls"

    def embed(batch):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in batch)
        return [[float(len(t)), 1.0] for t in batch]

    cache = EmbeddingCache(spark, str(tmp_path / "vectors"))
    model = BatchEmbedder(embed, "length", batch=3)
    cache.embed(text_frame(spark, ["a", "bb", "a"]), model).collect()
    out = cache.embed(text_frame(spark, ["a", "bb", "ccc"]), model).orderBy("text_id").collect()
    assert [list(r["embedding"]) for r in out] == [[1, 1], [2, 1], [3, 1]]
    assert sorted(log.read_text().split()) == ["a", "bb", "ccc"]


def test_prompt_proposer(spark, tmp_path):
    calls = tmp_path / "calls"

    def model(batch):
        first = not calls.exists()
        calls.write_text(batch[0])
        return ["I apologize, but no"] * len(batch) if first else ['is long"\n- "has a b"\n- "is long"'] * len(batch)

    df = text_frame(spark, [f"w{i} x" for i in range(30)]).withColumn("y", F.col("text_id").cast("double"))
    proposer = PromptProposer(model, samples=12, own={"find": ["mine", "is long"]})
    got = proposer.propose(df, "y", "find")
    assert got.descriptions == ["is long", "has a b", "mine"]
    assert got.raw_responses and len(got.shown) == 12
    prompt = calls.read_text()
    assert "Sample 0: w0 x (score: 0.0)" in prompt and "w29 x (score: 29.0)" in prompt and "find" in prompt
    assert PromptProposer(lambda b: [None] * len(b)).propose_unscored(df).descriptions == []


def test_similarity_judge_skips_single_words(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("x y", "x z"), ("x y", "x y"), ("a", "b c")], "a string, b string")
    judge = SimilarityJudge(lambda batch: ["related" if "x z" in p else "Yes" for p in batch])
    got = {(r["a"], r["b"]): r["similarity"] for r in agreement.surface_similarity(pairs, "a", "b", judge).collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 0, ("x y", "x z"): 0.5, ("x y", "x y"): 1, ("a", "b c"): 0}


def test_dedup_by_prefix(spark):
    df = spark.createDataFrame([("x; b",), ("x; a",), ("y",)], "d string")
    assert sorted(r["description"] for r in dedup_by_prefix(df, "d").collect()) == ["x; b", "y"]


def test_merge_proposals(spark):
    pool = spark.createDataFrame([(0, "a"), (1, "b")], "place int, predicate string")
    new = spark.createDataFrame([(0, "b"), (1, "c"), (2, "d")], "place int, predicate string")
    merged = proposers.merge_proposals(pool, new, ["z", "a"], limit=2).orderBy("part", "place").collect()
    assert [r["predicate"] for r in merged] == ["a", "b", "c", "z"]


def test_problem_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"texts": ["x", "y"], "K": 2, "goal": None, "reference_phi_denotation": [[1, 0], [0, 1]], "reference_phi_predicate_strings": ["p", "q"]}))
    rows, settings = problems.load_problem(spark, str(path))
    assert [(r["position"], r["text"], list(r["reference"])) for r in rows.orderBy("position").collect()] == [(0, "x", [1, 0]), (1, "y", [0, 1])]
    assert settings["K"] == 2 and settings["goal"] is None and settings["reference_phi_predicate_strings"] == ["p", "q"]
    listed = tmp_path / "l.json"
    listed.write_text(json.dumps(["u", "v"]))
    assert [r["text"] for r in problems.texts_from_json(spark, str(listed)).orderBy("text_id").collect()] == ["u", "v"]
    listed.write_text(json.dumps({"texts": ["u", "v"], "labels": [1, 0]}))
    assert [r["label"] for r in problems.texts_from_json(spark, str(listed)).orderBy("text_id").collect()] == [1, 0]


def test_run_log(spark, tmp_path):
    path, now = str(tmp_path / "runs"), datetime(2024, 1, 2)
    assert results.load_results(spark, path).count() == 0
    results.record_run(spark, path, "r0", "cluster", "news", 0, "normal", 0.5, True, now - timedelta(days=9))
    results.record_run(spark, path, "r1", "cluster", "news", 1, "normal", started=now - timedelta(hours=1))
    results.record_run(spark, path, "r2", "cluster", "news", 2, "normal", started=now - timedelta(hours=25))
    results.record_run(spark, path, "r3", "cluster", "dummy", 0, "normal", 0.9, True, now)
    log = results.read_or_empty(spark, path, results.RESULTS)
    sets = spark.createDataFrame([("cluster", "news"), ("cluster", "dummy")], "problem_type string, dataset string")
    left = results.pending_runs(results.run_grid(sets, 4), log, F.lit(now))
    assert sorted(r["seed"] for r in left.collect()) == [2, 3]
    assert [r["run_id"] for r in results.load_results(spark, path).collect()] == ["r0"]


def test_average_of_averages(spark):
    rows = [("c", "x", "normal", v) for v in (0.0, 0.0, 0.9)] + [("c", "y", "normal", 1.0)]
    df = spark.createDataFrame(rows, "problem_type string, dataset string, tag string, main_f1 double")
    got = {r["dataset"]: r["normal"] for r in results.summarize_performance(df).collect()}
    assert got == pytest.approx({"x": 0.3, "y": 1.0, "avg": 0.65})


def test_taxonomy_goes_past_z(spark):
    df = spark.createDataFrame([(0, "top", [f"s{i}" for i in range(28)])], "place int, predicate string, children array<string>")
    codes = {r["predicate"]: r["code"] for r in results.expand_taxonomy(df).collect()}
    assert codes["top"] == "0" and codes["s0"] == "0.A" and codes["s25"] == "0.Z" and codes["s26"] == "0.AA" and codes["s27"] == "0.AB"


def test_clustering_recovers_planted_predicates(spark):
    texts = planted()
    model = ClusteringModel(text_frame(spark, texts), 4, reference=Reference(one_hot(spark, texts), list(LETTERS)))
    out = model.fit()
    assert sorted(out.predicates) == list(LETTERS)
    assert out.loss == pytest.approx(math.log(50), abs=1e-6)
    assert out.f1_similarity_score == 1.0 and out.surface_similarity_score == 1.0
    assert out.aligned_predicates == list(LETTERS)
    assert out.trajectory_table().orderBy("step").first()["tag"] == "init"
    matches = out.matches(text_frame(spark, texts))
    assert matches.filter("value = 1").count() == 200


def test_clustering_with_a_paid_scorer_gives_the_same(spark, tmp_path):
    texts = planted(80)
    log = tmp_path / "calls"
    scorer = BatchScorer(counting(str(log)), "paid")
    out = ClusteringModel(text_frame(spark, texts), 4, scorer=scorer, rounds=2, gain=1e-3).fit()
    assert sorted(out.predicates) == list(LETTERS)
    assert out.predicates == ClusteringModel(text_frame(spark, texts), 4, rounds=2, gain=1e-3).fit().predicates
    lines = log.read_text().splitlines()
    assert len(lines) == len(set(lines))


def test_labels(spark):
    texts = planted(120, seed=2)
    rows = [(i, t, 5 if t[0] in "ab" else 9) for i, t in enumerate(texts)] + [(200, texts[0], 5)]
    df = spark.createDataFrame(rows, "text_id bigint, text string, label int")
    out = explain_labels(df, 2)
    # Without an intercept, the half of the texts that shows neither predicate stays at even odds.
    assert out.explanation.loss == pytest.approx(0.5 * math.log(2), abs=1e-4)
    assert len(set(out.explanation.predicates) & set(LETTERS)) == 2
    weights = out.weights.collect()
    assert {r["class"] for r in weights} == {9} and len(weights) == 2


def test_classification_weights_match_newton(spark):
    rng = np.random.default_rng(0)
    phi = (rng.random((150, 2)) < 0.5).astype(int)
    y = (rng.random(150) < 0.2 + 0.5 * phi[:, 0]).astype(int)
    rows = [(i, [int(v) for v in p], int(l)) for i, (p, l) in enumerate(zip(phi, y))]
    df = spark.createDataFrame(rows, "text_id bigint, phi array<int>, label int")
    got = [r["weight"] for r in classification_weights(df, 2).orderBy("predicate_id").collect()]
    x = np.column_stack([phi, np.ones(150)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        ridge = np.array([1.0, 1.0, 0.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    np.testing.assert_allclose(got, w[:2], atol=1e-4)


def test_trend_recovers_planted_predicates(spark):
    rng = np.random.default_rng(5)
    texts = [f"{'efgh'[rng.integers(4)]} {LETTERS[i // 40]} {rng.random():.12f}" for i in range(160)]
    rows = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)] + [(999, texts[0])], "time bigint, text string")
    out = explain_trend(rows, 3, gain=1e-3)
    assert len(set(out.explanation.predicates) & set(LETTERS)) == 3
    weights = out.weights().orderBy("t").collect()
    assert [r["t"] for r in weights] == list(range(160)) and {len(r["w"]) for r in weights} == {3}
    curves = out.curves.orderBy("t").collect()
    assert len(curves) == 161 and curves[-1]["time"] == 999
    assert out.features.count() == 161


def test_trend_with_tied_times_of_any_type(spark):
    """Ids are places, not times: texts of one moment stay apart."""
    import datetime

    texts = [f"{LETTERS[i // 20]} {i % 7} {i}" for i in range(80)]
    rows = [(datetime.datetime(2024, 1, 1 + i // 10), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (datetime.datetime(2024, 2, 1), texts[0])], "time timestamp, text string")
    placed = series_texts(df).orderBy("t").collect()
    assert [r["t"] for r in placed] == list(range(80)) == [r["text_id"] for r in placed]
    assert [r["first_at"] for r in placed] == sorted(t for t, _ in rows) and {r["text"] for r in placed} == set(texts)
    out = explain_trend(df, 2, buckets=8, rounds=1, gain=1e-3)
    assert out.features.count() == 81 and out.curves.count() == 81


def test_committers_ask_once_per_text(spark, tmp_path):
    log = tmp_path / "asked"

    def answer(prompts):
        with open(log, "a") as f:
            f.writelines(f"{len(p)}\n" for p in prompts)
        return ["[1]"] * len(prompts)

    df = text_frame(spark, ["a", "b", "a", "a", "c"])
    got = PromptCommitter(answer).commit(df, ["x", "y"])
    assert sorted(tuple(r["phi"]) for r in got.collect()) == [(0, 1)] * 5
    assert len(log.read_text().splitlines()) == 3
    cache = EmbeddingCache(spark, str(tmp_path / "answers"))
    for _ in range(2):
        got = PromptCommitter(answer, cache=cache).commit(df, ["x", "y"])
        assert sorted(tuple(r["phi"]) for r in got.collect()) == [(0, 1)] * 5
    assert len(log.read_text().splitlines()) == 6
    PromptCommitter(answer, cache=cache).commit(df, ["x", "z"]).collect()
    assert len(log.read_text().splitlines()) == 9


def test_the_scan_of_a_fit_is_not_one_task(spark):
    """The screen and the state keep the partitions of the texts."""
    model = ClusteringModel(text_frame(spark, planted(80)).repartition(3), 2, rounds=0, gain=1e-3)
    model.fit()
    assert model.state.rdd.getNumPartitions() == model.base.rdd.getNumPartitions() >= 3
    plan = model.state._jdf.queryExecution().toString() + model.sampled._jdf.queryExecution().toString()
    assert "Coalesce" not in plan


def test_sums_do_not_depend_on_partitions(spark):
    table = materialise(spark.range(500).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).repartition(40), "t")
    passes = Passes(table)
    passes.partitions = 300
    kernel = lambda rows: np.concatenate([rows.x.sum(axis=0), np.full(9000, len(rows.x), float)])
    got = passes.sums([kernel, kernel])
    assert all(g[0] == 499 * 250 and g[1] == 500 and (g[2:] == 500).all() and len(g) == 9002 for g in got)


def test_random_update_and_empty_pool(spark):
    texts = planted(40)
    out = ClusteringModel(text_frame(spark, texts), 2, random_update=True, rounds=1).fit()
    assert len(out.predicates) == 2
    model = ClusteringModel(text_frame(spark, texts), 2, proposer=PromptProposer(lambda b: [None] * len(b), samples=4))
    with pytest.raises(ValueError, match="no predicate"):
        model.fit()


def test_distinct_texts_once(spark):
    out = explain_clusters(text_frame(spark, ["a x", "a x", "b y", "b z"]), 2, rounds=1)
    assert out.denotation.count() == 3


def test_own_models_are_reexported():
    assert issubclass(ClassificationModel, object) and TimeSeriesModel and TokenProposer and HashedBowEmbedder


def test_experiment_grid_runs_once(spark, tmp_path):
    texts = planted(40)
    problem = {
        "texts": texts, "K": 4, "smoothing_prob": 1.0, "goal": None,
        "reference_phi_predicate_strings": list(LETTERS),
        "reference_phi_denotation": [[int(t[0] == c) for c in LETTERS] for t in texts],
    }
    file = tmp_path / "planted.json"
    file.write_text(json.dumps(problem))
    files = {("cluster", "planted"): str(file), ("cluster", "dummy"): str(file)}
    out = str(tmp_path / "out")
    done = run_experiments(spark, files, out, seeds=1, rounds=1)
    assert len(done) == 1 and done[0].f1_similarity_score == 1.0
    assert run_experiments(spark, files, out, seeds=1, rounds=1) == []
    table = results.summarize_performance(results.load_results(spark, f"{out}/runs")).collect()
    assert {(r["dataset"], r["normal"], r["no_refine"]) for r in table} == {("planted", 1.0, 1.0), ("avg", 1.0, 1.0)}
    assert spark.read.parquet(f"{out}/matches").filter("value = 1").count() == 40


def test_one_hot_ablation(spark):
    out = ClusteringModel(text_frame(spark, planted(24)), 2, embedder=OneHotEmbedder(), rounds=1).fit()
    assert len(out.predicates) == 2


def test_embedding_column(spark):
    df = text_frame(spark, planted(24))
    table = df.select("text_id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = ClusteringModel(df, 2, embedder=ColumnEmbedder(table), rounds=1).fit()
    assert len(out.predicates) == 2
