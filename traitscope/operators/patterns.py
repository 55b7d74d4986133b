"""Pattern counts and the statistics that need nothing else.

For 0/1 denotations every fitness depends on the texts only through how many texts show
each pattern of bits. One aggregation, merged before its shuffle to a long key and a
counter, turns any number of texts into at most 2^K rows (K: number of predicates).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = 62  # bits that fit a non-negative BIGINT


def pack(phi: Column, k: int) -> Column:
    """The 0/1 array as one BIGINT, bit i for entry i."""
    total = F.lit(0).cast("bigint")
    for i in range(k):
        total = total + F.shiftleft(F.get(phi, F.lit(i)).cast("bigint"), i)
    return total


def unpack(bits: Column, k: int) -> Column:
    return F.array(*[F.shiftright(bits, i).bitwiseAND(F.lit(1)).cast("int") for i in range(k)])


def pattern_counts(den: DataFrame, k: int, *by: str, binary: bool = True) -> DataFrame:
    """(phi, *by, cnt) of a denotation; ``by`` holds a label or a time bucket.

    Real-valued scores are grouped as arrays; they may give as many rows as there are texts.
    """
    if k > PACKED or not binary:
        return den.groupBy("phi", *by).agg(F.count("*").alias("cnt"))
    packed = den.select(pack(F.col("phi"), k).alias("bits"), *by)
    counted = packed.groupBy("bits", *by).agg(F.count("*").alias("cnt"))
    return counted.select(unpack(F.col("bits"), k).alias("phi"), *by, "cnt")


def cluster_fitness(patterns: DataFrame, k: int, smoothing: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Mean of -ln max_k p(text | predicate k) per group: columns (*by, n, loss).

    p(text | k) = phi / (sum of phi + 1e-6), not below smoothing / n. The column sums are one
    row per group and join back to the pattern table, which Spark reads from the same shuffle.
    """
    by = list(by)
    sums = patterns.groupBy(*by).agg(
        F.sum("cnt").alias("n"),
        F.array(
            *[F.sum(F.get("phi", F.lit(i)).cast("double") * F.col("cnt")) + F.lit(1e-6) for i in range(k)]
        ).alias("mass"),
    )
    if by:
        joined = patterns.join(sums, by)
        n, mass = F.col("n"), F.col("mass")
    else:
        joined = patterns
        n, mass = sums.select("n").scalar(), sums.select("mass").scalar()
    joined = joined.withColumn("_n", n).withColumn("_mass", mass)
    best = F.greatest(
        F.lit(float(smoothing)) / F.col("_n"),
        *[F.get("phi", F.lit(i)).cast("double") / F.get("_mass", F.lit(i)) for i in range(k)],
    )
    return (
        joined.withColumn("nll", -F.ln(best))
        .groupBy(*by)
        .agg(F.sum("cnt").alias("n"), (F.sum(F.col("nll") * F.col("cnt")) / F.sum("cnt")).alias("loss"))
    )


def without(phi: Column, k: int, index: Column) -> Column:
    """``phi`` with the entry at ``index`` set to 0 (no entry has the index -1)."""
    return F.array(*[F.when(index == i, F.lit(0)).otherwise(F.get(phi, F.lit(i))) for i in range(k)])


def ablated(patterns: DataFrame, k: int, *by: str) -> DataFrame:
    """The pattern table once as it is (``variant`` -1) and once per predicate with its column zeroed."""
    variants = patterns.withColumn("variant", F.explode(F.array(*[F.lit(i) for i in range(-1, k)])))
    changed = variants.withColumn("phi", without(F.col("phi"), k, F.col("variant")))
    return changed.groupBy("variant", "phi", *by).agg(F.sum("cnt").alias("cnt"))


def duplicate_predicates(patterns: DataFrame, k: int) -> DataFrame:
    """(predicate_id, has_twin): is another column equal to this one on all texts?

    For each pair of columns, one minimum over the patterns; the pairs are pairs of
    predicates, and the texts are already merged into patterns.
    """
    pairs = [(i, j) for i in range(k) for j in range(k) if i != j]
    ids = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("predicate_id")
    if not pairs:
        return patterns.select(ids).distinct().withColumn("has_twin", F.lit(False))
    same = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("predicate_id"), (F.get("phi", F.lit(i)) == F.get("phi", F.lit(j))).alias("eq"), F.lit(j).alias("other"))
                for i, j in pairs
            ]
        )
    ).alias("p")
    twins = patterns.select(same).select("p.*").groupBy("predicate_id", "other").agg(F.min("eq").alias("eq"))
    return twins.groupBy("predicate_id").agg(F.max("eq").alias("has_twin"))


def ablation_loss(patterns: DataFrame, k: int, smoothing: float = 1.0) -> DataFrame:
    """(predicate_id, increase, has_twin, place): least useful predicate first.

    ``increase`` is the cluster fitness lost by zeroing the column; columns with an equal
    twin come before all others.
    """
    losses = cluster_fitness(ablated(patterns, k), k, smoothing, ["variant"])
    base = losses.filter("variant = -1").select("loss").scalar()
    scored = losses.filter("variant >= 0").select(
        F.col("variant").alias("predicate_id"), (F.col("loss") - base).alias("increase")
    )
    joined = scored.join(duplicate_predicates(patterns, k), "predicate_id")
    order = F.when(F.col("has_twin"), F.lit(float("-inf"))).otherwise(F.round("increase", 12))
    return small_rank(joined.withColumn("_order", order), ["_order", "predicate_id"], "place").drop("_order")


def small_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based place in a table with one row per predicate (never per text)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def swapped(patterns: DataFrame, k: int, slot: int, candidates: int, *by: str) -> DataFrame:
    """Variants of a pattern table whose ``phi`` has the candidates' bits after the first ``k``.

    Variant j replaces entry ``slot`` by candidate j; the rows are merged again.
    """
    which = patterns.withColumn("variant", F.explode(F.array(*[F.lit(j) for j in range(candidates)])))
    entries = [
        F.get("phi", F.lit(k) + F.col("variant")) if i == slot else F.get("phi", F.lit(i)) for i in range(k)
    ]
    return (
        which.withColumn("phi", F.array(*entries))
        .groupBy("variant", "phi", *by)
        .agg(F.sum("cnt").alias("cnt"))
    )


def candidate_losses(
    patterns: DataFrame, k: int, slot: int, candidates: int, smoothing: float = 1.0
) -> DataFrame:
    """(variant, loss): cluster fitness after putting each candidate into ``slot``, in one job."""
    return cluster_fitness(swapped(patterns, k, slot, candidates), k, smoothing, ["variant"]).select("variant", "loss")


def best_candidate(losses: DataFrame, current: float) -> DataFrame:
    """The first candidate with the lowest loss, if that is strictly below ``current``."""
    best = losses.agg(
        F.min_by("variant", F.struct("loss", "variant")).alias("variant"), F.min("loss").alias("loss")
    )
    return best.filter(F.col("loss") < F.lit(float(current)))


def predicate_correlation(den: DataFrame, k: int, target: str, absolute: bool = False) -> DataFrame:
    """(predicate_id, correlation) of each column with ``target``; 0 for a constant column.

    Covariance and variances are running centred moments, merged before the shuffle.
    """
    pairs = den.select(F.posexplode_outer("phi").alias("predicate_id", "value"), F.col(target).cast("double").alias("_y"))
    moments = pairs.groupBy("predicate_id").agg(
        F.covar_pop("value", "_y").alias("c"),
        F.var_pop("value").alias("vx"),
        F.var_pop("_y").alias("vy"),
    )
    r = F.coalesce(F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))), F.lit(0.0))
    return moments.select("predicate_id", (F.abs(r) if absolute else r).alias("correlation"))


def rank_candidates(correlations: DataFrame) -> DataFrame:
    """Place of each predicate by falling correlation; ties keep the order of the ids."""
    return small_rank(correlations, [F.round("correlation", 12).desc(), F.col("predicate_id")], "place")


def random_rank(predicates: DataFrame, seed: int = 0) -> DataFrame:
    """Ablation: a seeded shuffle of the candidates in place of their ranking."""
    return small_rank(predicates, [F.md5(F.concat(F.lit(f"{seed}:"), F.col("predicate_id").cast("string")))], "place")


def predicate_report(den: DataFrame, texts: DataFrame, predicates: Sequence[str], examples: int = 5) -> DataFrame:
    """(predicate_id, predicate, matches, sample): count of matches and the first matching texts.

    The ranking runs on ids: Spark keeps the first few per predicate within each input
    partition before it shuffles, and only those ids fetch their text.
    """
    from pyspark.sql import Window

    k = len(predicates)
    counts = den.agg(
        F.array(*[F.coalesce(F.sum(F.get("phi", F.lit(i)).cast("bigint")), F.lit(0).cast("bigint")) for i in range(k)]).alias("m")
    ).select(F.posexplode("m").alias("predicate_id", "matches"))
    hits = den.select("text_id", F.posexplode_outer("phi").alias("predicate_id", "value")).filter("value > 0")
    first = (
        hits.withColumn("rn", F.row_number().over(Window.partitionBy("predicate_id").orderBy("text_id")))
        .filter(F.col("rn") <= examples)
        .select("text_id", "predicate_id", "rn")
    )
    # At most examples x predicates ids, so they can be sent to every scan of the texts.
    shown = texts.select("text_id", "text").join(F.broadcast(first), "text_id")
    samples = shown.groupBy("predicate_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "text"))), lambda s: s["text"]).alias("sample")
    )
    names = F.element_at(F.array(*[F.lit(p) for p in predicates]), F.col("predicate_id") + 1)
    return (
        counts.join(samples, "predicate_id", "left")
        .select(
            "predicate_id",
            names.alias("predicate"),
            "matches",
            F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
        )
    )


def feature_rows(den: DataFrame, rows: DataFrame, predicates: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Feature columns, one per predicate, for rows that name their ``text_id``."""
    names = names or [f"f{i}" for i in range(len(predicates))]
    wide = den.select("text_id", *[F.get("phi", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return rows.join(wide, "text_id")
