"""Packing, archives, quality rules, licenses, tokenizers, toxicity and scoring against brute force."""

import gzip
import hashlib
import io
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitscope.llm import licenses as L
from traitscope.llm import lm_scoring as M
from traitscope.llm import packing as P
from traitscope.llm import quality_rules as Q
from traitscope.llm import sentencepiece_codec as C
from traitscope.llm import toxicity as T
from traitscope.llm import warc as W
from traitscope.llm.queries import REGISTRY
from traitscope.llm.tokens import encoder

from .conftest import ODD

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = {c: c + 32 for c in range(65, 91)}
#: White space and markers of all kinds, alone and in runs.
SPACES = st.text(alphabet=st.sampled_from(list("  ab.\n\t▁é日🙂'1 \x0b\x1c\x85")), max_size=40)


# --- tokenizers --------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(SPACES)
def test_units_give_the_ids_of_the_whole_text(text):
    whole = encoder(BPE).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(BPE).ids([text])[0], "<u4").tolist() == whole


@pytest.fixture(scope="module")
def codec():
    import sentencepiece

    with open(PIECES, "rb") as f:
        data = f.read()
    return C.Codec(data, 2), sentencepiece.SentencePieceProcessor(model_proto=data)


@settings(max_examples=300, deadline=None)
@given(text=SPACES)
def test_sentencepiece_parity(codec, text):
    own, library = codec
    ids = np.frombuffer(own.encode([text])[0], "<u4")
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == text.replace(C.MARK, " ")
    assert not text or C.build(own.model).encode(text, add_special_tokens=False).ids == library.encode(text)


def message(number, payload):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def unigram_model(remove_extra):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.1), ("▁a", -2.5), ("ab", -4.0), ("▁ab", -4.1), ("ba", -3.7), ("abb", -5.5), ("é", -6.0))]
    data = b"".join(message(1, message(1, p.encode()) + message(2, s) + message(3, k)) for p, s, k in pieces)
    trainer = message(3, 1) + message(4, len(pieces)) + message(35, 1) + message(40, 0) + message(41, 1) + message(42, 2) + message(43, (1 << 64) - 1)
    rules = message(1, b"identity") + message(3, 1) + message(4, int(remove_extra)) + message(5, 1)
    return data + message(2, trainer) + message(3, rules)


@pytest.mark.parametrize("remove_extra", [False, True])
def test_unigram_parity(remove_extra):
    """A model of unigram scores with byte fallback, written by hand."""
    import sentencepiece

    data = unigram_model(remove_extra)
    own, library = C.Codec(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert own.by_unit != remove_extra
    texts = ["ab", "abba ab", "a  b", " ab ", "é ab", "x", "日 ab", "", "abbabba babba", "b\na"]
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text), text


def test_sentencepiece_query(spark, folder, documents, texts, codec, odd, empty):
    rows = REGISTRY["op7_sentencepiece"](spark, folder).collect()
    assert len(rows) == documents.count()
    for r in rows:
        ids = codec[1].encode(texts[r.doc_id])
        assert r.parity and r.round_trip and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    coded = C.sentencepiece_code(odd, PIECES, keep_ids=True)
    assert Counter(r.doc_id for r in coded.collect()) == Counter(r[0] for r in ODD)
    back = C.sentencepiece_decode(coded, PIECES)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t, *_ in ODD)
    assert C.sentencepiece_code(empty, PIECES).count() == 0


# --- packing -----------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(2, 12))
def test_every_piece_is_packed_once(lengths, groups):
    lengths = np.array(lengths, np.int64)
    bins = P.pack_lengths(lengths, 64, groups=groups)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(b and lengths[b].sum() <= 64 for b in bins)


@pytest.mark.parametrize("kind", ["uniform", "large", "small"])
def test_packing_is_near_the_bound(kind):
    rng = np.random.default_rng(3)
    lengths = {"uniform": rng.integers(1, 1024, 20000), "large": rng.integers(300, 700, 20000), "small": np.minimum(1023, rng.lognormal(5, 1, 20000).astype(int) + 1)}[kind]
    bins = P.pack_lengths(lengths, 1024)
    plain: list = []
    P.best_fit(lengths, np.argsort(-lengths), plain, [], 1024)
    assert len(bins) <= 1.002 * len(plain)
    if kind != "large":
        assert len(bins) <= 1.01 * math.ceil(lengths.sum() / 1024)


def test_configurations_solve_the_program():
    columns, use = P.patterns(np.array([6, 4, 3]), np.array([10.0, 10.0, 10.0]), 10)
    assert (columns * np.array([[6], [4], [3]])).sum(0).max() <= 10
    assert np.allclose(columns @ use, 10) and use.sum() == pytest.approx(13 + 1 / 3)


def check_packing(rows, documents, capacity=1024):
    tokenizer = encoder(BPE).tokenizer
    want, places = Counter(), defaultdict(list)
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark, folder, documents):
    rows = REGISTRY["op2_best_fit_packing"](spark, folder).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert n <= 1.02 * math.ceil(sum(r.length for r in rows) / 1024)


def test_packing_of_odd_rows(odd, empty):
    check_packing(P.pack(odd, BPE, shard=4).collect(), [r[:2] for r in ODD])
    assert P.pack(empty, BPE).count() == 0
    kept = P.pack(odd, BPE, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept)


# --- archives ----------------------------------------------------------------------------

PAGES = [
    (1, "http://a/x y", "<p>" + "é" * 60),
    (2, None, "<p>" + "é" * 60),
    (5, "http://b\r\nX: y", "<p>" + "é" * 60),
    (5, "http://b\r\nX: y", "<p>" + "é" * 60),
    (None, "http://c", "<p>" + "é" * 60),
    (None, "http://d", "n" * 200),
    (None, "http://e", "n" * 200),
    (7, "http://f", None),
    (8, "http://g", ""),
    (9, "http://h", "short"),
    (10, "http://i", "short"),
    (11, "http://j", "a\r\n\r\nb\0" * 70000),
    (12, "http://k", "a\r\n\r\nb\0" * 70000),
]


def test_archives(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    pages = pages.withColumn("digest", F.lit(1)).withColumn("offset", F.lit(2))
    index = W.write_archives(pages, str(tmp_path), archive_bytes=2000)
    rows = W.read_archives(index, str(tmp_path), payloads=True).collect()
    want = Counter()
    for page_id, url, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        first = min(same) if same and len(data) >= 100 else None
        refers = first if first is not None and page_id != first else None
        clean = None if url is None else url.replace(" ", "%20").replace("\r\n", "%0D%0A")
        want[(page_id, clean, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else data)] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in rows) == want
    # Any selection of the index reads those records alone, and any tool reads the archives.
    some = index.where("page_id in (5, 9)")
    assert sorted(r.page_id for r in W.read_archives(some, str(tmp_path)).collect()) == [5, 5, 9]
    for name in {r.archive for r in index.collect()}:
        content = gzip.open(io.BytesIO((tmp_path / name).read_bytes())).read()
        assert content.count(b"WARC/1.1\r\nWARC-Type: ") == index.where(f"archive = '{name}'").count()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.archive_pages(empty).count() == 0


def test_reading_is_dealt_by_archive_bytes(spark, tmp_path):
    """The index alone is a few kilobytes; the records are dealt over all cores."""
    rng = np.random.default_rng(4)
    pages = [(i, f"http://x/{i}", rng.bytes(1500).hex()) for i in range(300)]
    index = W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path), archive_bytes=100_000)
    rows = W.read_archives(index, str(tmp_path), smallest=10_000).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.page_id for r in rows}) == 300
    sizes = Counter(r.task for r in rows)
    assert len(sizes) > 1 and max(sizes.values()) < 200


def test_a_damaged_record_is_refused():
    good = W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "n")
    assert W.parse(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r", b"qayload\r"), good[:-3], b"x" + good):
        with pytest.raises(ValueError):
            W.parse(bad)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 90)), min_size=1, max_size=30), st.integers(0, 50), st.integers(1, 400))
def test_ranges_cover_all_places(steps, gap, most):
    places, at = [], 0
    for skip, length in steps:
        places.append((at + skip, length))
        at += skip + length
    found = W.ranges(places, gap, most)
    assert [i for a, b, _ in found for i in range(a, b)] == list(range(len(places)))
    for a, b, end in found:
        assert end == places[b - 1][0] + places[b - 1][1] and (b - a == 1 or end - places[a][0] <= most)


# --- quality rules ---------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_of_odd_rows(odd, empty):
    rows = Q.quality_rules(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((i, *brute_measures(t)) for i, t, *_ in ODD)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.kept or not r.base_failed) for r in rows)
    kept = Q.keep_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert Q.quality_rules(empty).count() == 0 and Q.keep_documents(empty).count() == 0


def test_repeats_of_a_text(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3 + i % 4, 60))) for i in range(40)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_repeat_words for r in Q.measures(docs).collect()}
    assert got == {i: brute_measures(t)[4] for i, t in rows}


def test_thresholds_adapt_to_the_group(spark):
    """Symbols that are usual in one source are junk in another."""
    plain = " ".join(f"word{i}" for i in range(40))
    marked = " ".join(f"word{i}{'#' if i % 4 else ''}" for i in range(40))
    rows = [(i, plain, "en", "prose") for i in range(50)] + [(100, marked, "en", "prose")] + [(200 + i, marked, "en", "code") for i in range(50)]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[100] and all(v for k, v in got.items() if k != 100)


def test_junk_cannot_lift_its_own_limit(spark):
    """Two fifths of a source are junk; longer words of another source are its own habit."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    text = lambda least, mark="": " ".join(word(int(rng.integers(least, least + 4))) + mark for _ in range(80))
    rows = [(i, text(3), "en", "web") for i in range(60)] + [(100 + i, text(3, "#"), "en", "web") for i in range(40)]
    rows += [(200 + i, text(9), "en", "law") for i in range(50)] + [(300, text(9), "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in Q.quality_rules(docs).collect()}
    assert {i for i, kept in got.items() if not kept} == {*range(100, 140), 300}


def test_quantiles_decide(spark, folder):
    """Most groups that are large enough have limits of their own, and most documents stay."""
    documents = spark.read.parquet(os.path.join(os.path.dirname(folder), "sf0.01", "documents.parquet"))
    table = spark.createDataFrame(Q.rated(Q.measures(documents)).drop("text").collect())
    large = table.where(~Q.base_failed()).groupBy("lang", "source").count().where("count >= 5").drop("count")
    limits = Q.thresholds(table, enough=5).join(large, ["lang", "source"]).drop("lang", "source").collect()
    assert len(set(limits)) > len(limits) / 2
    judged = Q.judged(table).where("not base_failed")
    assert judged.where("kept").count() >= 0.85 * judged.count()


# --- licenses ----------------------------------------------------------------------------


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in L.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    own = {label for label, t in L.TEMPLATES for i in range(len(words)) if words[i : i + len(t.split())] == t.split()}
    base = {label for _, label in found}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))


def test_license_query(spark, folder, documents):
    rows = REGISTRY["op6_license_scan"](spark, folder).collect()
    want = Counter((r.doc_id, *brute_licenses(r.text)) for r in documents.collect())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows) == want


def test_license_scan_of_odd_rows(odd, empty):
    rows = L.scan_licenses(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter((i, *brute_licenses(t)[:5]) for i, t, *_ in ODD)
    assert all(0 <= r.score <= 1 for r in rows) and {r.doc_id: r.labels for r in rows}[10] == "cc-by,cc-by-nc,reserved"
    assert L.scan_licenses(empty).count() == 0


def test_changed_notices_are_verified(spark):
    notice = dict(L.TEMPLATES)["bsd"].split()
    changed = notice[:8] + ["extra", "word"] + notice[8:]
    half = notice[: len(notice) // 2]
    rows = [(1, "Intro. " + " ".join(notice).upper()), (2, "x y z " + ", ".join(changed)), (3, " ".join(half)), (4, "and binary forms with the rest")]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "bsd" and got[3].labels == got[4].labels == ""
    assert got[1].score == 1.0 and 0.8 <= got[2].score <= 1 and 0.3 < got[3].score < 0.8


# --- toxicity ----------------------------------------------------------------------------


def test_hidden_words_and_capitals_of_any_script():
    of = lambda text: dict(zip(T.FEATURES, T.features(text, {}, {})))
    far = "x" * 100 + "."
    for text in ("you i d i o t there", "a i-d-i-o-t", f"{far}idi0t", "word\tidi0t\tword", "well-idi0t!", "i*d*i*o*t"):
        assert of(text)["hidden_hits"] > 0, text
    assert of("I am a man, e.g. of a to b c")["hidden_hits"] == 0
    assert of("ÄÖÜ ist das")["shouted"] > 0 and of("ééé oui")["stretched"] > 0 and of("ÄÖÜ")["capitals"] > 0
    assert {b"abcd-", b"abcdef-"} <= T._entries("abcdefg")


def test_toxicity_on_held_out_rows(spark, folder):
    import os

    docs, labels = (spark.read.parquet(os.path.join(folder.replace("sf0.001", "sf0.01"), f"{t}.parquet")) for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    truth = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    toxic, clean = [s for s, y in truth if y], [s for s, y in truth if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.8


def test_labels_of_the_held_out_fold_are_not_used(spark, odd, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    a = T.toxicity(odd, labels).collect()
    assert Counter(r.doc_id for r in a) == Counter(r[0] for r in ODD) and all(0 <= r.score <= 1 for r in a)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert Counter(map(tuple, T.toxicity(odd, turned).collect())) == Counter(map(tuple, a))
    assert T.toxicity(empty, labels).count() == 0
    assert {r.score for r in T.toxicity(odd, labels.where("false")).collect()} == {0.0}


def test_features():
    lexicon, starts = {b"moron": 4.0}, {"réeux".encode()[:5]: 3.0}
    f = dict(zip(T.FEATURES, T.features("You MORON!! réeuxment m0ron", lexicon, starts)))
    assert f["word_hits"] == pytest.approx(math.log(2)) and f["closest"] == 0.5 and f["hidden_hits"] == pytest.approx(math.log(2))
    assert f["start_rate"] > 0 and f["strongest"] == 4.0 and f["capitals"] > 0 and f["exclamations"] > 0
    assert T.features("", lexicon, starts) == [0.0] * len(T.FEATURES)


# --- language-model scores ----------------------------------------------------------------


def brute_base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def check_base(rows, documents):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=order)
    want = sorted(brute_base(documents), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_lm_query(spark, folder, documents):
    rows = REGISTRY["op1_lm_scoring"](spark, folder).collect()
    check_base(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows)


def test_lm_scores_do_not_depend_on_the_frequent_words(spark, odd, empty):
    few, many = (sorted(map(tuple, M.score_texts(odd, frequent=n).collect()), key=repr) for n in (3, 1 << 18))
    check_base(M.score_texts(odd, frequent=3).collect(), [r[:2] for r in ODD])
    assert [r[:5] for r in few] == [r[:5] for r in many]
    # A word that is read again without its own score can only lose, and little.
    assert all(b[6] - 0.1 * b[2] <= a[6] <= b[6] + 1e-6 for a, b in zip(few, many))
    assert M.score_texts(empty).count() == 0


def test_bits_are_a_distribution():
    """Over all next bytes the bit model's probabilities sum to 1."""
    rng = np.random.default_rng(1)
    parts = [b"ba", b"rel", b"to", b"shan", b"gi", b"ud", b"ment", b"or"]
    word = lambda: b"".join(parts[i] for i in rng.integers(0, 8, rng.integers(1, 5)))
    words = sorted({word() for _ in range(900)})
    fresh = [w for w in (word() for _ in range(500)) if w not in words]
    grams, n = np.unique(M.grams_of(words)[0], return_counts=True)
    zeros, ones = np.zeros(M.OFFSETS[-1], np.float32), np.zeros(M.OFFSETS[-1], np.float32)
    for j in range(8):
        bit = (grams >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        for cells in M._cells(grams, j):
            np.add.at(zeros, cells[~bit], n[~bit])
            np.add.at(ones, cells[bit], n[bit])
    model = M.BitModel(zeros, ones)
    before = model.log10(fresh).mean()
    model.learn(grams, n)
    assert model.log10(fresh).mean() > before
    for prefix in (b"", b"ba", b"relshan"):
        # P(prefix + next byte, ...) telescopes: the mass of words with a prefix is that of its next bytes.
        def mass(text):
            grams = M.grams_of([text])[0][: len(text)]
            return sum(model_bits(model, g) for g in grams)

        total = sum(10 ** (mass(prefix + bytes([c])) - mass(prefix)) for c in range(256) if c != 32)
        end = 10 ** (model.log10([prefix])[0] - mass(prefix))
        assert total + end == pytest.approx(1, abs=1e-6)


def model_bits(model, gram):
    """log10 of one byte after its context, by the model's own steps."""
    table, total, one = model.refined(), 0.0, np.array([gram], np.uint64)
    for j in range(8):
        logits, gate, bit = model.inputs(one, j, leave=False)
        mixed = model.mix(logits, gate)
        place = ((mixed + 8) * 2).clip(0, M.BUCKETS - 1.001)
        low = place.astype(int)
        before = int(gram) >> 8 & 255
        final = (mixed + table[before, low] * (1 - place + low) + table[before, low + 1] * (place - low)) / 2
        total -= float(np.logaddexp(0, np.where(bit > 0, -final, final))[0])
    return total / math.log(10)


def test_mixing_scores_words_seen_in_training_by_what_stands_before_them(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "night falls on the hill " * 3) for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows += [(held[0], "Night falls  on the hill"), (held[1], "hill the on falls night")]
    got = {r.doc_id: r for r in M.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]].n_known == got[held[1]].n_known == 6
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 1


def test_token_scores_are_the_mixed_bits(monkeypatch):
    """Every token's score is the sum over its bytes after up to 6 bytes of the text, whatever table and pieces are used."""
    texts = [b"the hill the night falls", b"", b"on the hill", b"x" * 40 + b" the the"]
    tokens = [w for t in texts for w in [*M.words_of(t), b""]]
    counts = np.array([len(t.split()) + 1 for t in texts])
    stream = [b"".join(w + b" " for w in [*t.split(), b""]) for t in texts]
    want = [[int.from_bytes(t[max(0, i - 6) : i + 1], "big") for i in range(len(t))] for t in stream]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["text"])
    for piece in (1 << 20, 5):
        monkeypatch.setattr(M, "PIECE", piece)
        assert np.concatenate(list(M.grams_of_texts(tokens, counts))).tolist() == sum(want, [])
        counted = Counter()
        for b in M._grams(iter([batch, batch])):
            for g, n in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist()):
                counted[g] += n
        assert counted == Counter(sum(want, []) * 2)
    rng = np.random.default_rng(3)
    zeros, ones = (rng.integers(0, 9, M.OFFSETS[-1]).astype(np.float32) for _ in range(2))
    model = M.BitModel(zeros, ones)
    each = [[model_bits(model, np.uint64(g)) for g in w] for w in want]
    sums = []
    for t, e in zip(stream, each):
        at = 0
        for w in [*t.split(), b""]:
            sums.append(sum(e[at : at + len(w) + 1]))
            at += len(w) + 1
    grams = np.unique(np.array(sum(want, []), np.uint64))
    for some in (grams[:0], grams[::2]):
        keys, scores = M.in_slots(some, model.of_grams(some))
        assert np.allclose(M.token_scores(model, keys, scores, tokens, counts), sums)


class Sent:
    """What a task sees of a broadcast."""

    def __init__(self, value):
        self.value = value


def test_scoring_looks_up_a_word_once_a_slice_and_takes_one_logarithm_a_byte(monkeypatch):
    """Lookups of every token and six logarithms for each bit took most of the time of a scoring task."""

    class Counting(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    rng = np.random.default_rng(5)
    model = M.BitModel(*(rng.integers(0, 9, M.OFFSETS[-1]).astype(np.float32) for _ in range(2)))
    frozen, grams = model.frozen(), np.unique(M.grams_of([b"the hill the night falls"])[0])
    want, table = [model_bits(model, g) for g in grams], (grams[::2], model.of_grams(grams[::2]))
    taken, log10 = [], np.log10
    for name in ("log", "log1p", "logaddexp"):
        monkeypatch.setattr(np, name, lambda *x: pytest.fail("a logarithm of a bit"))
    monkeypatch.setattr(np, "log10", lambda x: taken.append(np.size(x)) or log10(x))
    assert np.allclose(frozen.of_grams(grams), want)
    assert sum(taken) == len(grams)
    at = Counting({b"the": 0, b"": 1, b"hill": 2})
    texts = ["The hill the NIGHT falls night"] * 50 + ["", "hill"]
    columns = [pa.array(range(52)), pa.array(range(52)), pa.array([False] * 52), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held", "text"])
    run = M._score_texts(Sent((at, np.array([True, True, False]), np.array([-1.0, -2.0, -3.0]), *table)), Sent(frozen))
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert at.asked == 5
    assert [(r["n_bytes"], r["n_tokens"], r["n_known"], r["base"]) for r in rows[49:52]] == [(30, 7, 3, -7.0), (0, 1, 1, -2.0), (4, 2, 1, -5.0)]
    assert Counter((r["word"], r["times"]) for r in rows[52:]) == {(b"night", 2): 50, (b"falls", 1): 50}


def test_words_are_counted_over_slices_and_flushes(monkeypatch):
    texts = ["the Hill the night", "", None, "hill  falls\nthe", "x" * 50] * 3
    held = [False, True, False, True, False] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(held), pa.array([t or "" for t in texts])], ["held", "text"])
    want = Counter(w for t in texts for w in [*M.words_of((t or "").encode()), b""])
    train = Counter(w for h, t in zip(held, texts) if not h for w in [*M.words_of((t or "").encode()), b""])
    for flush in (1, 3, 1 << 18):
        monkeypatch.setattr(M, "FLUSH", flush)
        monkeypatch.setattr(M, "slices", lambda sizes, most=0: [(i, i + 2) for i in range(0, len(sizes), 2)])
        n, m = Counter(), Counter()
        for b in M._count(iter([batch, batch])):
            for word, x, y in zip(*(c.to_pylist() for c in b.columns)):
                n[word] += x
                m[word] += y
        assert m == want + want and +n == train + train


def test_memories_count_what_came_before():
    codes = np.array([5, 6, 5, 6, 5, 9, 9])
    static = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.0, 0.0])
    got = M.memory_sums(codes, np.array([0, 5]), np.array([5, 2]), static)
    single, pair = [0, 0, 1 / 2, 1 / 3, 2 / 4], [0, 0, 0, 1, 1]
    for k, (one, two) in enumerate(M.MEMORY):
        want = sum(math.log10((1 - one - two) * s + one * a + two * b) for s, a, b in zip(static[:5], single, pair))
        assert got[0, k] == pytest.approx(want)
    # The unknown word: its first place keeps the static share, its second counts by the memories.
    one, two = M.MEMORY[3]
    assert got[1, 3] == pytest.approx(math.log10(1 - one - two) + math.log10(one))
    assert got[1, 0] == 0


def test_training_sample_is_the_smallest_hashes(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    for sample in (1, 50, 700, 5000):
        ranked = labels.where(T.fold("doc_id", T.FOLDS) != T.HELD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        assert {r.doc_id for r in T.training_rows(docs, labels, sample).collect()} == {r.doc_id for r in ranked.collect()}


def test_cell_counts_beyond_single_precision():
    """16,777,216 is the last whole number that single precision can raise by one."""
    batch = pa.RecordBatch.from_arrays([pa.array([97] * 3, pa.int64()), pa.array([1 << 24, 1, 1], pa.int64())], ["gram", "n"])
    out = pa.Table.from_batches(list(M._cell_counts(iter([batch])))).to_pydict()
    assert {z + o for z, o in zip(out["zeros"], out["ones"])} >= {(1 << 24) + 2}
    assert all((z + o) % ((1 << 24) + 2) == 0 for z, o in zip(out["zeros"], out["ones"]))
