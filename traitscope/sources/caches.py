"""Verdict and embedding tables that grow, so that nothing is paid for twice.

A cache is a parquet folder in storage that all executors reach. Each call joins it on the
128-bit key of the text, computes what is missing, writes the new part and only then goes
on, so a lost executor never repeats a call whose answer was written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hot import dealt_join

VERDICTS = T.StructType(
    [
        T.StructField("text_key", T.BinaryType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("model", T.StringType()),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("text_key", T.BinaryType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
    ]
)
KNOWN, COMPUTED = 0, 1
#: Bytes of a file after ``compact``.
FILE_BYTES = 128 << 20


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def rewrite(spark: SparkSession, path: str, schema: T.StructType, model: str, kept: DataFrame, file_bytes: int) -> None:
    """Write ``kept`` beside the model's present files and then delete those.

    Run it between calls: tables that still read the old files fail afterwards. What others append
    meanwhile stays, as only the files seen at the start go; if the job ends between the two steps
    there are repeats, which reading leaves out.
    """
    rows = read_or_empty(spark, path, schema).filter(F.col("model") == model)
    old = [r.file for r in rows.select(F.input_file_name().alias("file")).distinct().collect() if r.file]
    if not old:
        return
    places = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in old]
    store = places[0].getFileSystem(spark._jsc.hadoopConfiguration())
    files = -(-sum(store.getFileStatus(p).getLen() for p in places) // file_bytes)
    spread = kept.repartition(max(files, 1), "text_key").sortWithinPartitions("text_key")
    spread.write.mode("append").partitionBy("model").parquet(path)
    for place in places:
        store.delete(place, False)


class VerdictCache:
    """Verdicts by (model, text key, predicate); known verdicts win over computed ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, model: str) -> DataFrame:
        """One verdict per (text_key, predicate): the one with the smallest priority.

        ``min_by`` has a fixed-width buffer, so repeats are merged before the shuffle.
        """
        rows = read_or_empty(self.spark, self.path, VERDICTS).filter(F.col("model") == model)
        return rows.groupBy("text_key", "predicate").agg(F.min_by("value", "priority").alias("value"))

    def compact(self, model: str, file_bytes: int = FILE_BYTES) -> None:
        """Rewrite the model's verdicts, one per key and predicate, into as few files as ``file_bytes`` asks for."""
        rows = read_or_empty(self.spark, self.path, VERDICTS).filter(F.col("model") == model)
        best = F.min_by("value", "priority").alias("value"), F.min("priority").alias("priority")
        kept = rows.groupBy("text_key", "predicate").agg(*best).withColumn("model", F.lit(model))
        rewrite(self.spark, self.path, VERDICTS, model, kept, file_bytes)

    def append(self, verdicts: DataFrame, model: str, priority: int = COMPUTED) -> None:
        """Add (text_key, predicate, value) rows; null verdicts are not remembered."""
        (
            verdicts.filter(F.col("value").isNotNull())
            .select(
                "text_key",
                "predicate",
                F.col("value").cast("double"),
                F.lit(priority).alias("priority"),
                F.lit(model).alias("model"),
            )
            .write.mode("append")
            .partitionBy("model")
            .parquet(self.path)
        )

    def seed(self, known: DataFrame, model: str) -> None:
        """Preload verdicts that are known: rows of (text, predicate, value)."""
        keyed = known.select(F.unhex(F.md5("text")).alias("text_key"), "predicate", "value")
        self.append(keyed, model, KNOWN)


class EmbeddingCache:
    """Embeddings by (model, text key)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, model: str) -> DataFrame:
        """One embedding per text key.

        Repeats come only from callers that append at the same time. Their keys are looked for by a
        count of fixed width, and only their rows are grouped: vectors of other keys are not shuffled.
        """
        rows = read_or_empty(self.spark, self.path, VECTORS).filter(F.col("model") == model).select("text_key", "embedding")
        again = rows.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select("text_key")
        if again.isEmpty():
            return rows
        several = rows.join(again, "text_key", "left_semi").dropDuplicates(["text_key"])
        return rows.join(again, "text_key", "left_anti").unionByName(several)

    def compact(self, model: str, file_bytes: int = FILE_BYTES) -> None:
        """Rewrite the model's entries, one per key, into as few files as ``file_bytes`` asks for."""
        kept = self.read(model).withColumn("model", F.lit(model))
        rewrite(self.spark, self.path, VECTORS, model, kept, file_bytes)

    def embed(self, texts: DataFrame, embedder) -> DataFrame:
        """Append ``embedding`` to ``texts``, computing only the texts not yet in the table."""
        keyed = texts.withColumn("text_key", F.unhex(F.md5("text")))
        # Only keys and ids meet the cache; texts are fetched for the misses alone.
        keys = keyed.groupBy("text_key").agg(F.min("text_id").alias("text_id"))
        missing = keys.join(self.read(embedder.name).select("text_key"), "text_key", "left_anti").select("text_id")
        misses = keyed.join(missing, "text_id", "left_semi")
        (
            embedder.embed(misses)
            .select("text_key", F.col("embedding").cast("array<float>"), F.lit(embedder.name).alias("model"))
            .write.mode("append")
            .partitionBy("model")
            .parquet(self.path)
        )
        return dealt_join(keyed, self.read(embedder.name), "text_key", F.col("text_id")).drop("text_key")
