"""Joins with hot keys against plain joins, and caches after many appends."""

import os
from collections import Counter

from pyspark.sql import functions as F

from traitscope.operators.denote import denote
from traitscope.operators.hot import dealt_join, hot_keys
from traitscope.operators.scorers import BatchScorer
from traitscope.operators.texts import scatter_back, text_key
from traitscope.sources.caches import KNOWN, EmbeddingCache, VerdictCache


class Lengths:
    """Embeds a text as its length."""

    name = "lengths:v1"

    def embed(self, texts):
        return texts.withColumn("embedding", F.array(F.length("text").cast("float")))


def hot_rows(spark, n=3000):
    """A third of the rows are one text, a sixth have none."""
    text = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 == 1, None).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    return spark.range(n).select(F.col("id").alias("text_id"), text.alias("text"))


def test_a_hot_text_is_spread_over_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = hot_rows(spark)
        scored = rows.where("text is not null").groupBy(text_key("text").alias("text_key")).agg(F.min("text_id").alias("first"))
        back = scatter_back(rows, scored).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(r.text_id for r in back) == Counter(i for i in range(3000) if i % 6 != 1)
    assert all(r.first == (0 if r.text == "hot" else r.text_id) for r in back)
    sizes = Counter(r.task for r in back if r.text == "hot")
    assert len(sizes) == tasks and max(sizes.values()) < 2 * 1000 / tasks


def test_dealt_joins_equal_plain_joins(spark):
    rows = hot_rows(spark, 600).withColumn("other", F.col("text_id") % 5)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("t2", 3), (None, 4)], "text string, value int")
    for left in (rows, rows.select("text"), rows.where("false"), rows.where("text is null"), rows.where("text = 'hot'")):
        for how in ("inner", "left"):
            want = Counter(map(tuple, left.join(right, "text", how).collect()))
            got = dealt_join(left, right, "text", how=how)
            assert got.columns == left.join(right, "text", how).columns
            assert Counter(map(tuple, got.collect())) == want
    assert hot_keys(rows.where("text like 't%'"), "text", 4) is None


def files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_embeddings_after_fifty_appends(spark, tmp_path):
    cache, model = EmbeddingCache(spark, str(tmp_path / "v")), Lengths()
    cache.compact(model.name)
    other = Lengths()
    other.name = "other"
    texts = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(40)], "text_id long, text string")
    cache.embed(texts, other)
    for i in range(50):
        part = texts.limit(3).withColumn("text", F.concat("text", F.lit(f" {i // 2}")))
        keyed = model.embed(part.coalesce(1)).select(text_key("text").alias("text_key"), "embedding", F.lit(model.name).alias("model"))
        # Two callers at a time write the same entries.
        keyed.write.mode("append").partitionBy("model").parquet(cache.path)
    before = {bytes(r.text_key): r.embedding for r in cache.read(model.name).collect()}
    kept = len(files(cache.path + "/model=other"))
    assert len(before) == 75 == cache.read(model.name).count()
    cache.compact(model.name)
    assert len(files(cache.path)) == 1 + kept
    assert {bytes(r.text_key): r.embedding for r in cache.read(model.name).collect()} == before
    assert cache.read("other").count() == 9
    plan = cache.read(model.name)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    out = cache.embed(texts, model).collect()
    assert {r.text_id: list(r.embedding) for r in out} == {i: [float(i % 9)] for i in range(40)}


def test_verdicts_keep_their_priority(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "v"))
    scorer = BatchScorer(lambda p, t: [float(a in b) for a, b in zip(p, t)], "contains:v1")
    texts = spark.createDataFrame([(0, "a b"), (1, "b"), (2, "c"), (3, "c")], "text_id long, text string")
    key = texts.select(text_key("text").alias("text_key"), F.lit("a").alias("predicate"))
    for i in range(5):
        cache.append(key.withColumn("value", F.lit(0.0)), scorer.name)
    cache.append(key.where("text_key is not null").withColumn("value", F.lit(1.0)), scorer.name, KNOWN)
    cache.compact(scorer.name)
    assert len(files(cache.path)) == 1
    cache.append(key.withColumn("value", F.lit(0.0)), scorer.name)
    assert {r.value for r in cache.read(scorer.name).collect()} == {1.0}
    assert cache.read(scorer.name).count() == 3
    got = {r.text_id: list(r.phi) for r in denote(texts, ["a"], scorer, cache).collect()}
    assert got == {0: [1.0], 1: [1.0], 2: [1.0], 3: [1.0]}
