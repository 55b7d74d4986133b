"""Readers for problem files and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM = T.StructType(
    [
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("texts_by_time", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("K", T.IntegerType()),
        T.StructField("goal", T.StringType()),
        T.StructField("smoothing_prob", T.DoubleType()),
        T.StructField("discontinuity_penalty", T.DoubleType()),
        T.StructField("reference_phi_predicate_strings", T.ArrayType(T.StringType())),
        T.StructField("reference_phi_denotation", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def read_problem(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The raw JSON objects, one per line: rows of parallel arrays and scalars.

    ``multi_line`` is for a file with one object over several lines, which one task has to read.
    """
    return spark.read.schema(PROBLEM).option("multiLine", multi_line).json(path)


def problem_rows(raw: DataFrame) -> DataFrame:
    """(position, text, label, reference): the parallel arrays turned into rows."""
    texts = F.coalesce("texts", "texts_by_time")
    # arrays_zip of a missing array is null, of a short one is padded with null.
    labels = F.coalesce("labels", F.array().cast("array<int>"))
    phi = F.coalesce("reference_phi_denotation", F.array().cast("array<array<double>>"))
    zipped = F.arrays_zip(texts.alias("text"), labels.alias("label"), phi.alias("phi"))
    rows = raw.select(F.posexplode(zipped).alias("position", "r"))
    return rows.select(
        F.col("position").cast("bigint").alias("position"),
        F.col("r.text"),
        F.col("r.label"),
        F.col("r.phi").alias("reference"),
    )


def load_problem(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, dict]:
    """Rows and settings of a problem file."""
    raw = read_problem(spark, path, multi_line)
    settings = raw.select(
        "K", "goal", "smoothing_prob", "discontinuity_penalty", "reference_phi_predicate_strings"
    ).first()
    return problem_rows(raw), settings.asDict()


def load_texts(df: DataFrame, text: str = "text", text_id: str = "doc_id") -> DataFrame:
    """(text_id, text) from any table."""
    return df.select(F.col(text_id).cast("bigint").alias("text_id"), F.col(text).alias("text"))


def load_labelled(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str | Column = "label") -> DataFrame:
    """(text_id, text, label) of the texts that have a label."""
    target = F.col(label) if isinstance(label, str) else label
    return texts.join(labels, key).select(
        F.col(key).cast("bigint").alias("text_id"), F.col(text).alias("text"), target.cast("int").alias("label")
    )


def texts_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, text) from a JSON list of strings, or (text_id, text, label) from an object
    with ``texts`` and ``labels``."""
    raw = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", "array<string>")
    both = F.from_json("value", "struct<texts: array<string>, labels: array<int>>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    parsed = raw.select(
        F.when(is_list, plain).otherwise(both["texts"]).alias("texts"),
        F.coalesce(F.when(~is_list, both["labels"]), F.array().cast("array<int>")).alias("labels"),
    )
    return parsed.select(F.posexplode(F.arrays_zip("texts", "labels")).alias("text_id", "r")).select(
        F.col("text_id").cast("bigint").alias("text_id"), F.col("r.texts").alias("text"), F.col("r.labels").alias("label")
    )
