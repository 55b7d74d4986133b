"""Phrase mining against plain counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from traitscope.llm import phrases as ph

NAMES = "doc_id long, text string, lang string"


def brute(docs, top=2000):
    """The contract in plain Python: [(lang, text)] -> rows."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= 100}
        inside = {p[i : i + m] for p, c in often.items() for m in range(1, len(p)) for i in range(len(p) - m + 1) if 100 * c >= 100 * often[p[i : i + m]]}
        rows = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in ph.phrase_collocations(df).collect())


def corpus():
    rng = random.Random(5)
    docs = []
    for i in range(3000):
        words = [rng.choice(["the", "of", "A", "größer", "x\x00y", "🙂"]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(words))
        words[at:at] = rng.choice([["New", "York", "City"], ["new", "york"], ["ha"] * 7, ["in", "spite", "of", "the", "rain", "today"], []])
        text = rng.choice([" ", "\t", "  "]).join(words) + rng.choice([".", "\r\n", "", "; and, so"])
        docs.append((rng.choice([i, 3, None]), text, rng.choice(["en", "en", "de", None])))
    return docs + [(1, None, "en"), (2, "", None), (2, " .,\t", "fr"), (4, "one long piece of words " * 3000, "en")]


def test_phrases_of_odd_texts(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, NAMES).repartition(4).selectExpr("*", "1 as prefix", "2 as n", "3 as phrase", "4 as f", "5 as _salt")
    want = brute([(lang, text) for _, text, lang in docs])
    assert len(want) > 20 and {r[0] for r in want} >= {"en", "de", "und"}
    assert mined(df) == want
    monkeypatch.setattr(ph, "HELD", 500)  # pieces of a task counted apart
    assert mined(df) == want


def test_ranks_and_top(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(ph, "TOP", 3)
    got = mined(spark.createDataFrame(docs, NAMES))
    assert got == brute([(lang, text) for _, text, lang in docs], 3)


def test_phrases_of_the_table(spark, documents):
    want = brute([(r.lang, r.text) for r in documents.select("lang", "text").collect()])
    assert mined(documents) == want


def test_one_reading_gives_stripes_buckets_and_stretches(spark):
    df = spark.createDataFrame([(i, "to be or not to be. to be", "en") for i in range(60)], NAMES).select("lang", "text")
    first = df.mapInArrow(ph._reading(1, {}), ph.PASS)
    merged = ph.stripes(first, 1)
    assert merged.groupBy().sum("total").first()[0] == 60 * 8
    shared = {1: [ph.frequent_filter(ph.extensions(merged))], 2: [ph.bucket_filter(first)]}
    second = df.mapInArrow(ph._reading(2, shared), ph.PASS)
    found = {(r.prefix, r.word): r.f for r in ph.extensions(ph.stripes(second, 2)).collect()}
    assert found == {("to", "be"): 180}
    assert second.where("kind = 2").count() == 0


def test_full_filters_change_nothing(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(ph, "_lookup", lambda shared: lambda hashes: np.ones(len(hashes), bool))
    assert mined(spark.createDataFrame(docs, NAMES)) == brute([(lang, text) for _, text, lang in docs])


def test_buckets_are_packed_and_added_up():
    rng = np.random.default_rng(0)
    numbers = np.unique(rng.integers(0, 1 << 20, 5000))
    counts = rng.integers(1, 101, len(numbers))
    back, times = ph._unpack(ph._pack(numbers, counts), len(numbers))
    assert (back == numbers).all() and (times == counts).all()


def test_scores_of_huge_counts():
    n = 10**17
    assert ph.worst_cut(10**15, n, [10**16, 10**15], [10**15, 10**16]) == (1000, 10**16, 10**16)
    assert ph.worst_cut(100, 10**17, [100], [100]) == (10**18, 100, 100)


def test_no_documents(spark):
    assert mined(spark.createDataFrame([], NAMES)) == []
    assert mined(spark.createDataFrame([(1, None, None), (2, "few words", "en")], NAMES)) == []
