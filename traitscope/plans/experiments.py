"""The experiment grid: problem files x seeds, each run once, with a log that can be resumed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedders import OneHotEmbedder
from ..session import materialise
from ..sources import results
from ..sources.problems import load_problem
from .models import ClassificationModel, ClusteringModel, Explanation, Model, Reference, TimeSeriesModel


def problem_model(spark: SparkSession, problem_type: str, path: str, **options) -> tuple[Model, DataFrame]:
    """The model of a problem file (types cluster, classification, time_series) and its texts."""
    rows, settings = load_problem(spark, path)
    rows = materialise(rows.withColumnRenamed("position", "text_id"), "problem")
    gold = rows.filter(F.col("reference").isNotNull()).select("text_id", F.col("reference").alias("phi"))
    reference = Reference(gold, settings["reference_phi_predicate_strings"]) if not gold.isEmpty() else None
    options = {"reference": reference, **options}
    k, goal = settings["K"], settings["goal"]
    if problem_type == "cluster":
        smoothing = settings["smoothing_prob"]
        model: Model = ClusteringModel(rows.select("text_id", "text"), k, goal, 1.0 if smoothing is None else smoothing, **options)
    elif problem_type == "classification":
        model = ClassificationModel(rows.select("text_id", "text", "label"), k, goal, **options)
    elif problem_type == "time_series":
        penalty = settings["discontinuity_penalty"]
        texts = rows.select("text_id", "text", F.col("text_id").alias("t"))
        model = TimeSeriesModel(texts, k, goal, 1.0 if penalty is None else penalty, **options)
    else:
        raise ValueError(f"unknown problem type {problem_type}")
    return model, rows


def run_experiments(
    spark: SparkSession,
    files: dict[tuple[str, str], str],
    path: str,
    seeds: int = 5,
    random_update: bool = False,
    one_hot: bool = False,
    **options,
) -> list[Explanation]:
    """Fit every (problem_type, dataset) of ``files`` for every seed that the log under ``path``
    does not show as finished or as started within a day; datasets named "dummy" are left out.

    ``options`` go to the models. Writes the run log, matches and trajectories, and logs the
    first step of a normal run under the tag "no_refine".
    """
    if random_update and one_hot:
        raise ValueError("choose either random_update or one_hot")
    tag = "random_update" if random_update else "one_hot" if one_hot else "normal"
    log = f"{path}/runs"
    sets = spark.createDataFrame(list(files), "problem_type string, dataset string")
    held = results.read_or_empty(spark, log, results.RESULTS).filter(F.col("tag") == tag)
    todo = results.pending_runs(results.run_grid(sets, seeds), held, F.current_timestamp())
    done = []
    for run in sorted(todo.collect()):
        name = f"{run['problem_type']}_{run['dataset']}_{run['seed']}_{tag}"
        key = (run["problem_type"], run["dataset"], run["seed"])
        began = datetime.now()
        results.record_run(spark, log, name, *key, tag, started=began)
        extra = {"embedder": OneHotEmbedder()} if one_hot else {}
        settings = {**options, **extra, "random_update": random_update, "seed": run["seed"]}
        model, rows = problem_model(spark, run["problem_type"], files[key[:2]], **settings)
        explanation = model.fit()
        results.write_explanation(explanation, rows, path, name)
        score = explanation.f1_similarity_score
        results.record_run(spark, log, name, *key, tag, score, True, began)
        if tag == "normal":
            first = explanation.trajectory[0].evaluation.metrics.get("main_f1")
            results.record_run(spark, log, f"{name}_first", *key, "no_refine", first, True, began)
        done.append(explanation)
    return done
