"""License scan by diagonal voting.

All rolling 3-word hashes of a text are joined to the positions of license templates. A hit votes
for the diagonal "position in the text minus position in the template"; votes are counted per
diagonal, neighbouring diagonals (a few words put in or left out) are merged, and a span is verified
by the share of the template's words that its hits cover. A k-gram can only hit if all its words
occur in templates, so other k-grams are left out before the join.

The base labels come from places where a phrase's words stand consecutively.

Defined cases: null or empty texts have no word, no label and score 0; null doc_ids and repeated
rows are scanned one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitscope.llm.common import LOWER_BYTES, trimmed, whole
from traitscope.session import materialise

#: Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices of well-known licenses, in words as the scan sees them.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K, NEIGHBOUR, COVER = 3, 3, 0.8

#: A-Z lowered; whatever is not an ASCII letter or digit or part of another character separates words.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER_BYTES)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def _vocabulary(phrases, templates) -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(sorted({w.encode() for _, t in templates for w in t.split()} | {w.encode() for p, _ in phrases for w in p.split()}))}


def gram_keys(ids: np.ndarray, k: int, size: int) -> np.ndarray:
    """Rolling keys of k word ids, 0 where a word is not in the vocabulary; exact, not only a hash."""
    n = max(len(ids) - k + 1, 0)
    key, whole_gram = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        key = key * size + part
        whole_gram &= part > 0
    return np.where(whole_gram, key, 0)


SCAN = "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<at:long,key:long>>"


def _scan(phrases, templates, k: int):
    vocabulary = _vocabulary(phrases, templates)
    size = len(vocabulary) + 1
    wanted = [(np.array([vocabulary[w.encode()] for w in p.split()]), label) for p, label in phrases]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in source:
            rows, ats, keys, counts = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = words_of(text.as_py())
                ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
                starts, labels = [], []
                for phrase, label in wanted:
                    n = max(len(ids) - len(phrase) + 1, 0)
                    at = np.flatnonzero(np.logical_and.reduce([ids[j : j + n] == w for j, w in enumerate(phrase)]))
                    if len(at):
                        starts.append(at)
                        labels.append(label)
                places = np.concatenate(starts) if starts else np.empty(0, int)
                key = gram_keys(ids, k, size)
                at = np.flatnonzero(key)
                ats.append(at)
                keys.append(key[at])
                counts.append(len(at))
                ends = (int(places.min()), int(places.max())) if len(places) else (None, None)
                rows.append((len(words), len(places), *ends, labels))
            if not rows:
                continue
            columns = list(zip(*rows))
            hits = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(ats), pa.int64()), pa.array(np.concatenate(keys), pa.int64())], ["at", "key"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.string())), lists],
                ["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"],
            )

    return run


def template_positions(spark, phrases=PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, words, key, place): as many rows as the templates have words."""
    vocabulary = _vocabulary(phrases, templates)
    rows = []
    for t, (label, text) in enumerate(templates):
        ids = np.array([vocabulary[w.encode()] for w in text.split()])
        rows += [(t, label, len(ids), int(x), i) for i, x in enumerate(gram_keys(ids, k, len(vocabulary) + 1))]
    return spark.createDataFrame(rows, "template int, label string, words int, key long, place long")


def spans(scanned: DataFrame, positions: DataFrame, k: int = K, neighbour: int = NEIGHBOUR) -> DataFrame:
    """(uid, template, label, first, last, cover): merged diagonals with the share of the template covered."""
    hits = scanned.select("uid", F.inline("hits")).join(F.broadcast(positions), "key")
    votes = hits.groupBy("uid", "template", "label", "words", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    by = Window.partitionBy("uid", "template").orderBy("diagonal")
    step = votes.withColumn("apart", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > neighbour).cast("int"), F.lit(1)))
    step = step.withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = step.groupBy("uid", "template", "label", "words", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1)))))
    return merged.select("uid", "template", "label", "first", (F.col("last") + k - 1).alias("last"), (covered / F.col("words")).alias("cover"))


def scan_licenses(docs: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    scanned = materialise(rows.mapInArrow(trimmed(_scan(PHRASES, TEMPLATES, K)), SCAN), "license-scan")
    found = spans(scanned.where(F.size("hits") > 0), template_positions(spark))
    labels = found.groupBy("uid").agg(
        F.collect_set(F.when(F.col("cover") >= cover, F.col("label"))).alias("own"), F.max("cover").alias("best")
    )
    out = scanned.drop("hits").join(labels.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left")
    own = F.coalesce("own", F.array().cast("array<string>"))
    best = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        best.alias("score"),
    )
