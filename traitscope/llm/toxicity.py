"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled rows (``sample``, by a hash of the id, only rows outside the held-out
fold) is dealt into three parts. From the first come lexicon entries: words and word beginnings that
stand in toxic texts far more often than in others. The trees are fitted on the second part, the
calibration on the third. Features of all texts are computed in one pass without a shuffle: lexicon
densities and weights, common insults, closeness of lexicon words to the second person, capitals, punctuation,
repeated letters and obfuscated words. Language, source, id and labels are no features.

Defined cases: null and empty texts have features of zero and are scored like any other; null
doc_ids are scored, never learned from; a null label is no label; of several labels of an id the
largest counts; repeated rows are scored one by one; without two classes in the sample every score is the share of
toxic labels (0 without any). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitscope.llm.common import fold, trimmed, whole
from traitscope.llm.tokens import slices
from traitscope.session import materialise

HELD, FOLDS, SAMPLE, ENTRIES, LEAST, THRESHOLD = 2, 4, 30_000, 400, 4, 0.3
#: Lengths, in bytes, of the word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
#: Everything but letters separates words; bytes of other characters are parts of words.
WORDS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Digits or signs between letters, where they stand for letters, and the run of letters and signs around them.
INSIDE, RUN, SIGNS = re.compile(r"(?<=[^\W\d_])[0-9@$!*+|]+(?=[^\W\d_])"), re.compile(r"(?:[^\W_]|[@$!*+|])*"), "0123456789@$!*+|"
#: Four or more letters apart by single signs or blanks.
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[.\-*_ ][^\W\d_](?![^\W\d_])){3,}")
#: Characters looked at on either side of a sign, and the longest word looked up among letters that stand apart.
REACH, LONGEST = 64, 24
LEET = str.maketrans("013457@$!|+", "oieastasiit")
SECOND = set(
    w.encode() for w in "you your yours yourself u ur du dich dir dein deine deiner deinem deinen tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros os".split()
)
#: Common insults, a lexicon to begin with where labelled rows are few.
INSULTS = set(
    w.encode() for w in (
    "idiot idiots moron morons stupid dumb fool pathetic worthless loser losers scum trash garbage disgusting clown jerk "
    "bastard creep filthy vermin dummkopf blödmann arschloch abschaum drecksack trottel versager imbécile idiote crétin "
    "connard ordure salaud abruti estúpido estúpida imbécil basura asqueroso escoria payaso inútil"
    ).split()
)
FEATURES = [
    "words", "insults", "insult_rate", "word_hits", "word_rate", "word_weight", "start_hits", "start_rate", "start_weight", "strongest", "second",
    "closest", "close_hits", "capitals", "shouted", "exclamations", "punctuation", "stretched", "mixed", "hidden_hits",
]


def words_of(lowered: bytes) -> list[bytes]:
    return lowered.translate(WORDS).split()


def _entries(text: str) -> set[bytes]:
    """Words of a text, and their beginnings marked by a trailing hyphen."""
    words = set(words_of(text.lower().encode()))
    return words | {w[:n] + b"-" for w in words for n in BEGINNINGS if len(w) >= n}


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (entry, toxic texts, other texts) of the batch."""
    for batch in source:
        toxic, other = Counter(), Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else other).update(_entries(text))
        names = list(toxic.keys() | other.keys())
        counts = [pa.array([c[n] for n in names], pa.int64()) for c in (toxic, other)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *counts], ["entry", "toxic", "other"])


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES, least: int = LEAST) -> dict[bytes, float]:
    """At most ``entries`` words and as many beginnings with their weights, from written rows (toxic, text)."""
    total = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = total.get(True, 0), total.get(False, 0)
    if not n1 or not n0:
        return {}
    seen = rows.select("toxic", "text").mapInArrow(trimmed(_count), "entry binary, toxic long, other long").groupBy("entry")
    seen = seen.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= least)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    ranked = seen.withColumn("weight", odds).withColumn("z", odds / error).where("weight > 1.5 and z > 3")
    out: dict[bytes, float] = {}
    start = F.endswith("entry", F.lit(b"-"))
    for kind in (start, ~start):
        for r in ranked.where(kind).orderBy(F.desc("z"), "entry").limit(entries).collect():
            out[bytes(r["entry"])] = r["weight"]
    return out


def _runs(mask: np.ndarray, n: int = 3) -> int:
    """Places where ``n`` neighbours all hold."""
    size = max(len(mask) - n + 1, 0)
    return int(np.count_nonzero(np.logical_and.reduce([mask[i : i + size] for i in range(n)])))


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it is a capital and whether it is a letter."""
    every = [chr(c) for c in range(0x110000)]
    return np.array([c.isupper() for c in every]), np.array([c.isalpha() for c in every])


def _hidden(text: str) -> tuple[int, list[list[bytes]]]:
    """Number of signs inside words and of spaced words, and for each place the words that it may hide."""
    found, count = {}, 0
    for m in SPACED.finditer(text):
        count += 1
        word = re.sub(r"[\W_]", "", m[0].lower())
        # A word of one letter may stand beside the spaced word.
        found[m.start()] = [word[a : a + n].encode() for a in range(len(word)) for n in range(4, min(LONGEST, len(word) - a) + 1)]
    for m in INSIDE.finditer(text):
        count += 1
        at = m.start()
        left = RUN.match(text[max(0, at - REACH) : at][::-1])[0]
        token = (left[::-1] + RUN.match(text, at, at + REACH)[0]).strip(SIGNS)
        found.setdefault(at - len(left), [re.sub(r"[\W_]", "", token.lower().translate(LEET)).encode()])
    return count, list(found.values())


def features(text: str, words_known: dict[bytes, float], starts_known: dict[bytes, float]) -> list[float]:
    """Dense features of one text, in the order of FEATURES."""
    lowered = text.lower().encode()
    words = words_of(lowered)
    n = len(words) or 1
    hits = [i for i, w in enumerate(words) if w in words_known or w in INSULTS]
    weight = [words_known.get(words[i], 0.0) for i in hits]
    insults = sum(words[i] in INSULTS for i in hits)
    starts = []
    for size in BEGINNINGS:
        starts += [starts_known[s] for s in [w[:size] for w in words] if s in starts_known]
    seconds = [i for i, w in enumerate(words) if w in SECOND]
    gaps = []
    for i in hits if seconds else ():
        j = bisect_left(seconds, i)
        gaps.append(min(abs(i - seconds[k]) for k in (j - 1, j) if 0 <= k < len(seconds)))
    mixed, places = _hidden(text)
    hidden = sum(any(w in words_known or w in INSULTS for w in place) for place in places)
    data = text.encode()
    chars = len(data) or 1
    if len(data) == len(text):
        codes, small = np.frombuffer(data, np.uint8), np.frombuffer(lowered, np.uint8)
        upper, letter = (codes >= 65) & (codes <= 90), (small >= 97) & (small <= 122)
    else:
        codes, small = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (text, text.lower()))
        upper, letter = _letters()[0][codes], _letters()[1][small]
    again = (small[1:] == small[:-1]) & letter[1:]
    marks = len(data) - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"))
    loud = len(data) - len(data.translate(None, b"!?"))
    return [
        log(1 + len(words)),
        log(1 + insults),
        insults / n,
        log(1 + len(hits)),
        len(hits) / n,
        sum(weight) / sqrt(n),
        log(1 + len(starts)),
        len(starts) / n,
        sum(starts) / sqrt(n),
        max([0.0, *weight, *starts]),
        len(seconds) / n,
        1 / (1 + min(gaps)) if gaps else 0.0,
        sum(g <= 5 for g in gaps) / n,
        int(np.count_nonzero(upper)) / chars,
        _runs(upper) / n,
        loud / chars,
        marks / chars,
        _runs(again, 2) / n,
        mixed / n,
        log(1 + hidden),
    ]


def _features(lexicon: dict[bytes, float]):
    words_known = {k: v for k, v in lexicon.items() if not k.endswith(b"-")}
    starts_known = {k[:-1]: v for k, v in lexicon.items() if k.endswith(b"-")}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            text_at = batch.num_columns - 1
            for a, b in slices(pc.binary_length(batch.column(text_at)).to_pylist()):
                part = batch.slice(a, b - a)
                rows = [features(t, words_known, starts_known) for t in part.column(text_at).to_pylist()]
                columns = [*part.columns[:text_at], *(pa.array(c, pa.float64()) for c in zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:text_at], *FEATURES])

    return run


def with_features(rows: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    """``rows`` with the features in place of their last column, the text."""
    kept = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(trimmed(_features(lexicon)), ", ".join(x for x in (kept, *(f"{f} double" for f in FEATURES)) if x))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A written table (doc_id, toxic, part, text) of at most ``sample`` labelled ids outside the held-out fold."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    labels = labels.where(fold("doc_id", FOLDS) != HELD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).where(fold("doc_id", FOLDS) != HELD)
    # The smallest hashes: a threshold from the number of ids leaves little more than the sample to be ordered.
    labels = materialise(labels, "toxic-labels")
    share = min(1.05 * sample / max(labels.count(), 1) + 1e-9, 1.0)
    most = min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)
    ranked = labels.where(F.xxhash64("doc_id") <= F.lit(most).cast("long")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = ranked.select(F.col("doc_id").alias("_id"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("part"))
    # At most ``sample`` ids are sent to the tasks; the texts are not shuffled.
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", (F.col("toxic") > 0).alias("toxic"), "part", "text")
    return materialise(joined, "toxic-sample")


class Scorer:
    """Trees and calibration fitted on rows with features, toxic and part."""

    def __init__(self, table: DataFrame, rounds: int = 30, depth: int = 3, rate: float = 0.2):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="features_")
        rows = self.assembler.transform(table.withColumn("label_", F.col("toxic").cast("double")))
        fit, rest = rows.where("part = 1"), rows.where("part = 2")
        classes = [part.select("label_").distinct().count() for part in (fit, rest)]
        self.share = rows.agg(F.avg("label_")).first()[0] or 0.0
        self.trees = self.calibration = None
        if classes[0] == 2:
            trees = GBTClassifier(featuresCol="features_", labelCol="label_", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=1)
            self.trees = trees.fit(fit)
        if self.trees is not None and classes[1] == 2:
            self.calibration = IsotonicRegression(featuresCol="raw_", labelCol="label_", predictionCol="score_").fit(self._raw(rest))

    def _raw(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.trees.transform(rows).withColumn("raw_", F.get(vector_to_array("probability"), F.lit(1)))

    def score(self, table: DataFrame) -> DataFrame:
        """(doc_id, score) of a table with features."""
        if self.trees is None:
            return table.select("doc_id", F.lit(float(self.share)).alias("score"))
        rows = self._raw(self.assembler.transform(table))
        if self.calibration is None:
            return rows.select("doc_id", F.col("raw_").alias("score"))
        # The calibration pools scores; a hundredth of the raw score keeps their order inside a pool.
        return self.calibration.transform(rows).select("doc_id", (0.99 * F.col("score_") + 0.01 * F.col("raw_")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows.where("part = 0"))
    scorer = Scorer(materialise(with_features(rows.where("part > 0"), lexicon), "toxic-training"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    scored = scorer.score(with_features(texts, lexicon))
    score = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
    )
