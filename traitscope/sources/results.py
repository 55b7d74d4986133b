"""Result tables of experiment runs: write, read, find what is still to run, summarise."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .caches import read_or_empty

RESULTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("problem_type", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("main_f1", T.DoubleType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("finished", T.BooleanType()),
    ]
)
TAGS = ("normal", "random_update", "one_hot", "no_refine")


def write_result(matches: DataFrame, path: str, run_id: str) -> None:
    """Append a long result (predicate, text, value, ...) under its run."""
    matches.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_explanation(explanation, texts: DataFrame, path: str, run_id: str) -> None:
    """Write a fit under ``path``: the matches (predicate, text, value) and the trajectory."""
    write_result(explanation.matches(texts), f"{path}/matches", run_id)
    write_result(explanation.trajectory_table(), f"{path}/trajectory", run_id)


def record_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    problem_type: str,
    dataset: str,
    seed: int,
    tag: str,
    main_f1: float | None = None,
    finished: bool = False,
    started: datetime | None = None,
) -> None:
    """Append one line to the run log: at the start (a claim) and again when finished."""
    row = [(run_id, problem_type, dataset, seed, tag, main_f1, started or datetime.now(), finished)]
    spark.createDataFrame(row, RESULTS).write.mode("append").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs on real datasets."""
    return real_results(read_or_empty(spark, path, RESULTS))


def real_results(results: DataFrame) -> DataFrame:
    return results.filter(F.col("finished") & (F.col("dataset") != "dummy") & F.col("main_f1").isNotNull())


def run_grid(datasets: DataFrame, seeds: int = 5) -> DataFrame:
    """(problem_type, dataset, seed) for every dataset and seed: the seeds are exploded in place."""
    seed = F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed")
    return datasets.filter(F.col("dataset") != "dummy").select("problem_type", "dataset", seed)


def pending_runs(grid: DataFrame, results: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Runs of the grid that are neither finished nor started less than ``hours`` ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp("started")
    busy = results.filter(F.col("finished") | (age < hours * 3600))
    keys = ["problem_type", "dataset", "seed"]
    return grid.join(busy.select(*keys), keys, "left_anti")


def summarize_performance(results: DataFrame, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(problem_type, dataset, one column per tag): mean F1 per dataset, and per problem type
    a row "avg" with the mean of the datasets' means."""
    each = results.groupBy("problem_type", "dataset").pivot("tag", list(tags)).agg(F.avg("main_f1"))
    avg = each.groupBy("problem_type").agg(F.lit("avg").alias("dataset"), *[F.avg(t).alias(t) for t in tags])
    return each.unionByName(avg)


def trajectory_scores(steps: DataFrame) -> DataFrame:
    """Results of the first and the last step of each run: tags "no_refine" and its own.

    ``steps`` has run_id, problem_type, dataset, seed, tag, step, main_f1.
    """
    ends = steps.groupBy("run_id", "problem_type", "dataset", "seed", "tag").agg(
        F.max_by("main_f1", "step").alias("last"), F.min_by("main_f1", "step").alias("first")
    )
    last = ends.select("run_id", "problem_type", "dataset", "seed", "tag", F.col("last").alias("main_f1"))
    first = ends.filter(F.col("tag") == "normal").select(
        "run_id", "problem_type", "dataset", "seed", F.lit("no_refine").alias("tag"), F.col("first").alias("main_f1")
    )
    return last.unionByName(first)


def expand_taxonomy(taxonomy: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(code, predicate, parent): top predicates numbered from 0, their children 0.A, 0.B, ...

    ``taxonomy`` has ``place``, ``predicate`` and ``children`` (array), one row per top predicate.
    With ``samples`` (predicate, text), there is one line per predicate and matching text.
    """
    tops = taxonomy.select(F.col("place").cast("string").alias("code"), "predicate", F.lit(None).cast("string").alias("parent"))
    subs = taxonomy.select("place", F.col("predicate").alias("parent"), F.posexplode("children").alias("i", "predicate"))
    letters = F.concat(F.when(F.col("i") >= 26, F.char(F.lit(64) + F.floor(F.col("i") / 26).cast("int"))).otherwise(""), F.char(F.lit(65) + F.col("i") % 26))
    coded = subs.select(F.concat(F.col("place").cast("string"), F.lit("."), letters).alias("code"), "predicate", "parent")
    lines = tops.unionByName(coded)
    if samples is None:
        return lines
    return lines.join(samples, "predicate", "left")
