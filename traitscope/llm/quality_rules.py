"""Quality rules with thresholds read from mergeable quantile sketches of each language and source.

Every document gets integer measures. KLL sketches of them are built per (lang, source) and merged
per language and over all documents. A measure is an outlier beyond ``median + reach * max(2 * (median
- q1), spread)`` of the document's group, and below ``median - reach * max(2 * (q3 - median), spread)``
for the low side of word length. Each side is measured on the other half of the documents, so outliers
on one side cannot widen their own limit until they are half of a source. There are no fixed cutoffs.
Groups of fewer than ``enough`` documents use the merged sketch of their language, or of all documents.
The thresholds are joined back on (lang, source).

Only DataFrame functions are used. Defined cases: a null text has no words and fails the base rule;
null lang or source form groups of their own; repeated rows are measured and returned one by one; an
empty table gives an empty result; other columns are ignored (``keep_documents`` returns them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import WORD_SQL, barrier, salted_join, whole
from traitscope.session import materialise

WINDOW = 5
#: measure -> least spread, for groups whose documents are nearly all alike; in thousandths but word length (hundredths).
RULES = {"symbols": 8, "dup_lines": 40, "repeats": 20, "echoes": 3, "capitals": 3, "word_length": 15}
#: Rates of shorter texts scatter, so they are taken as if over this many characters, words and lines.
CHARS, WORDS, LINES = 250, 50, 5
REACH = 6
ENOUGH = 30
#: Sketch size: exact up to about this many documents of a group, rank error about 0.1 % beyond.
SKETCH = 4096


def _repeat_words(words: Column, grams: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, from the windows' hashes."""

    def covered(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, i: (x["g"] == F.get(ordered, i - 1)["g"]) | (x["g"] == F.get(ordered, i + 1)["g"]),
        )
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        widths = F.transform(
            F.array(starts),
            lambda s: F.aggregate(
                F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )
        return F.get(widths, F.lit(0))

    placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    counted = F.get(F.transform(F.array(F.array_sort(placed)), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), counted).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_echoes, n_capitals (long)."""
    names = docs.columns
    step = barrier(docs.select(F.struct(*names).alias("_row"), whole().alias("_text")), _words=F.regexp_extract_all(whole("_text"), F.lit(WORD_SQL), F.lit(0)))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    step = barrier(step, _hashes=hashes, _lines=F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    last = F.size("_hashes") - WINDOW
    grams = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    echoes = F.size(F.filter("_hashes", lambda h, i: h == F.get("_hashes", i - 1)))
    step = barrier(step, _grams=grams, _echoes=echoes)
    long = lambda c: c.cast("long")
    return step.select(
        "_row.*",
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.regexp_count("_text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("_words"), F.col("_grams")).alias("n_repeat_words"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.col("_echoes")).alias("n_echoes"),
        long(F.regexp_count("_text", F.lit(r"[A-Z]"))).alias("n_capitals"),
    )


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rated(measured: DataFrame) -> DataFrame:
    """Add the measure of each rule."""
    per = lambda a, b, unit, least: F.expr(f"{unit} * {a} div greatest({b}, {least})")
    return measured.select(
        "*",
        per("n_symbols", "word_chars", 1000, CHARS).alias("symbols"),
        per("n_dup_lines", "n_lines", 1000, LINES).alias("dup_lines"),
        per("n_repeat_words", "n_words", 1000, WORDS).alias("repeats"),
        per("n_echoes", "n_words", 1000, WORDS).alias("echoes"),
        per("n_capitals", "word_chars", 1000, CHARS).alias("capitals"),
        per("word_chars", "n_words", 100, 1).alias("word_length"),
    )


def thresholds(measures_table: DataFrame, reach: int = REACH, enough: int = ENOUGH, k: int = SKETCH) -> DataFrame:
    """One row per (lang, source): lower and upper threshold of every measure.

    Only documents that pass the base rule shape the sketches.
    """
    sketch = [F.kll_sketch_agg_bigint(m, F.lit(k)).alias(m) for m in RULES]
    own = measures_table.where(~base_failed()).groupBy("lang", "source").agg(F.count("*").alias("n"), *sketch)
    own = materialise(own, "quality-sketches")
    merge = [F.kll_merge_agg_bigint(m, F.lit(k)).alias(f"{m}_m") for m in RULES]
    by_lang = own.groupBy(F.col("lang").alias("lang_m")).agg(F.sum("n").alias("n_m"), *merge)
    total = own.agg(F.sum("n").alias("n_t"), *[F.kll_merge_agg_bigint(m, F.lit(k)).alias(f"{m}_t") for m in RULES])
    # One row of sketches, of fixed size, for all documents.
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_m"))).join(F.broadcast(total), F.lit(True))
    chosen = {
        m: F.when(F.col("n") >= enough, F.col(m)).when(F.col("n_m") >= enough, F.col(f"{m}_m")).otherwise(F.col(f"{m}_t"))
        for m in RULES
    }
    out = []
    for m, spread in RULES.items():
        q1, middle, q3 = (F.kll_sketch_get_quantile_bigint(chosen[m], F.lit(q)) for q in (0.25, 0.5, 0.75))
        out.append((middle + reach * F.greatest(2 * (middle - q1), F.lit(spread))).cast("long").alias(f"{m}_high"))
        if m == "word_length":
            out.append((middle - reach * F.greatest(2 * (q3 - middle), F.lit(spread))).cast("long").alias(f"{m}_low"))
    return joined.select("lang", "source", *out)


def verdict() -> Column:
    """True where no measure is beyond its threshold. Groups without thresholds hold only documents that fail the base rule."""
    ok = F.col("word_length") >= F.col("word_length_low")
    for m in RULES:
        ok = ok & (F.col(m) <= F.col(f"{m}_high"))
    return F.coalesce(ok, F.lit(False))


def judged(table: DataFrame, reach: int = REACH, enough: int = ENOUGH) -> DataFrame:
    """A written table of measures with base_failed and kept."""
    limits = materialise(thresholds(table, reach, enough), "quality-thresholds")
    joined = salted_join(table, limits, ["lang", "source"], F.xxhash64("n_words", "word_chars"), how="left", written=True)
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict())


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the rules' measures of every row of ``docs``."""
    narrow = measures(docs.select("doc_id", "text", "lang", "source")).drop("text")
    table = materialise(rated(narrow), "quality-measures")
    return judged(table).select("doc_id", *BASE, "base_failed", "kept", *RULES)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    names = docs.columns
    packed = docs.select("text", "lang", "source", F.struct(*names).alias("_document"))
    table = materialise(rated(measures(packed)).drop("text"), "quality-measures")
    return judged(table).where("kept").select("_document.*").select(*names)
