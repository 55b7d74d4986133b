"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from traitscope.llm import exact_dedup as E
from traitscope.llm import simhash as S
from traitscope.llm import substring_dedup as D
from traitscope.llm.common import components
from traitscope.llm.near_copies import drop_near_copies

from .conftest import CLASH, ODD


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# --- components ------------------------------------------------------------------------


def union(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    want = union(pairs)
    loose = {a for a, b in pairs if a == b and all(a not in p for p in pairs if p != (a, a))}
    assert got == {k: v for k, v in want.items() if k not in loose}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


# --- exact copies ----------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=20000), st.integers(0, 20000))
def test_fingerprints_combine(data, cut):
    cut = min(cut, len(data))
    left, right = E.fingerprint(data[:cut]), E.fingerprint(data[cut:])
    parts = [(x >> 31, x & ((1 << 31) - 1)) for x in (left, right)]
    both = [E.combine(parts[0][w], parts[1][w], len(data) - cut, w) for w in (0, 1)]
    assert both[0] << 31 | both[1] == E.fingerprint(data)
    assert both[0] == int.from_bytes(b"", "big") if not data else both[0] == sum(b * pow(E.BASES[0], len(data) - 1 - i, E.PRIMES[0]) for i, b in enumerate(data)) % E.PRIMES[0]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        first = True
        for i in ids:
            out[(i, keep, len(ids), i == keep and first, sha(text))] += 1
            first = first and i != keep
    return out


def test_exact_on_odd_rows(odd, empty):
    got = Counter(map(tuple, E.exact_dedup(odd).drop("same_rows").collect()))
    assert got == brute_exact(ODD)
    assert E.exact_dedup(empty).count() == 0


def test_collision_of_fingerprints(spark, monkeypatch):
    """Texts with one fingerprint and length that differ leave their group."""
    rows = [(1, "ab" * 50), (2, "ba" * 50), (3, "ab" * 50), (4, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "_fingerprints", lambda c: F.length(c).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(docs, chunk_bytes=16, per_salt=1).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_drop_copies_keeps_columns(odd):
    out = E.drop_copies(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert Counter(r.text or "" for r in rows) == Counter({t or "": 1 for _, t, *_ in ODD})
    assert {r.doc_id for r in rows if (r.text or "") == ""} == {9}


# --- SimHash ----------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(rows, radius=2):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius]
    roots = union(pairs)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]].append(r[0])
    return Counter((r[0], f"{fps[i]:016x}", min(least[roots[i]], default=None)) for i, r in enumerate(rows))


def test_simhash_on_odd_rows(odd, empty):
    assert Counter(map(tuple, S.simhash_components(odd).collect())) == brute_components(ODD)
    assert S.simhash_components(empty).count() == 0


def test_simhash_query(spark, folder, documents):
    from traitscope.llm.queries import REGISTRY

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert Counter(map(tuple, REGISTRY["op9_simhash"](spark, folder).collect())) == brute_components(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps[50:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    over = S.beyond(S.planes_of(fps), fps[:70], radius)
    got = np.unpackbits(over.view(np.uint8), axis=1, bitorder="little")[:, :150]
    want = np.bitwise_count(fps[:70, None] ^ fps[None, :]) > radius
    assert (got == want).all()


@pytest.mark.parametrize("n", [64, 1000, 4096])
def test_blocks_are_abandoned(n):
    """Queries without a near lane give up the block though they and the padding stand in it."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    fps[-1] = fps[0] ^ np.uint64(1 << 62)
    planes, own, left = S.planes_of(fps), np.arange(60), []
    over = S.beyond(planes, fps[:60], 2, own, n, left)
    want = np.bitwise_count(fps[:60, None] ^ fps[None, :]) > 2
    assert (np.unpackbits(over.view(np.uint8), axis=1, bitorder="little")[:, :n] == want).all()
    assert left == [59]


def test_links_of_split_buckets(spark):
    """Buckets larger than a block give the same components."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(5)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(20), rng.randrange(3))) for b in base for _ in range(40)}
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = union([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])
    for block in (4096, 7):
        got = {r.node: r.root for r in components(S.links(table, block), "test").collect()}
        assert got == {k: v for k, v in want.items() if k in got}
        assert all(k in got or list(want.values()).count(v) == 1 for k, v in want.items())


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_copies(spark, odd, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(120, 400))]
        for c in range(3):
            copy = list(text)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((g * 10 + c, " ".join(copy)))
    for block_rows in (rows,):
        out = drop_near_copies(spark.createDataFrame(block_rows, "doc_id long, text string"))
        sets = [shingles(t) for _, t in rows]
        pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        roots = union([(min(p), max(p)) for p in pairs])
        assert sorted(r.doc_id for r in out.collect()) == [rows[i][0] for i in range(len(rows)) if roots[i] == i]
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns
    # Empty texts are one group, both long texts, and the three foxes.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 3, 4, 6, 8, 10])
    assert drop_near_copies(empty).count() == 0


# --- passages --------------------------------------------------------------------------


def passages_corpus(seed=4):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in range(300)]
    rare = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [rare(51 + k) for k in range(8)]
    rows, planted = [], set()
    for d in range(80):
        text = rare(rng.randrange(30, 400))
        if d % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = shared[d // 4 % 8]
            planted.add(d)
        lines = " ".join(text)
        rows.append((d, lines[: len(lines) // 2] + "\n" + lines[len(lines) // 2 :] if d % 3 == 1 and d % 4 else lines))
    rows.append((200, "one common line of some words that many texts have."))
    rows += [(201 + i, f"one common line of some words that many texts have. {' '.join(rare(40))}") for i in range(10)]
    return rows, planted, shared


def test_passages_are_caught_and_clean_texts_left(spark):
    rows, planted, shared = passages_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = D.repeated_passages(docs).collect()
    assert {r.doc_id for r in out} == planted
    first = {}
    for d in sorted(planted):
        first.setdefault(d // 4 % 8, d)
    assert {r.doc_id for r in out if r.removed} == planted - set(first.values())
    texts = dict(rows)
    for r in out:
        piece = texts[r.doc_id].encode()[r.start : r.end].decode().split()
        passage = shared[r.doc_id // 4 % 8]
        assert len(piece) == r.n_words and " ".join(piece) in " ".join(passage)
        assert texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words] == piece
    cleaned = {r.doc_id: r.text for r in D.remove_passages(docs).collect()}
    assert all(cleaned[d] == t for d, t in rows if d not in planted or d in first.values())
    assert all(" ".join(shared[d // 4 % 8]) not in cleaned[d] for d in planted - set(first.values()))


def test_passages_blocks_and_filter_do_not_change_the_result(spark):
    rows, _, _ = passages_corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = Counter(map(tuple, D.repeated_passages(docs).collect()))
    assert whole == Counter(map(tuple, D.repeated_passages(docs, block=2, filter_bits=8).collect()))


def test_whole_passages_go(spark):
    """Every word of a stretch of PASSAGE words or more that an earlier document has is removed."""
    rng = random.Random(11)
    fresh = iter(range(10**9))
    new = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        passage = new(rng.randrange(D.PASSAGE, 120))
        for copy in range(3):
            # The second document has the passage's first half and a little more; the third has it all.
            own = passage[: len(passage) // 2 + 20] if copy == 1 else passage
            before, after = new(rng.randrange(0, 60)), new(rng.randrange(0, 60))
            rows.append((3 * k + copy, " ".join(before + own + after)))
            want[3 * k + copy] = (before, after) if copy and len(own) >= D.PASSAGE else (before + own + after, [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text.split() for r in D.remove_passages(docs).collect()}
    full = [d for d, t in rows if len(want[d][0] + want[d][1]) < len(t.split())]
    assert len(full) > 70
    for d in full:
        # A paragraph with another first or last word is still similar, so one word more may go at either end.
        before, after = want[d]
        assert left.get(d, []) in [before[: len(before) - x] + after[y:] for x in (0, 1) for y in (0, 1)]
    assert all(left[d] == t.split() for d, t in rows if d % 3 == 0)
    out = D.repeated_passages(docs).collect()
    assert all(str(r.doc_id // 3 * 3) in r.keep_doc_ids.split(",") for r in out if r.removed)
    assert all(str(r.cluster_id) in r.cluster_ids.split(",") for r in out)


def test_passages_of_odd_rows(odd, empty):
    out = D.repeated_passages(odd)
    assert {r.doc_id for r in out.collect()} == {4, 5, 6, 7}
    cleaned = D.remove_passages(odd)
    assert cleaned.columns == odd.columns and cleaned.dtypes == odd.dtypes
    ids = Counter(r.doc_id for r in cleaned.collect())
    assert ids[6] == 2 and ids[None] == 2 and set(CLASH) <= set(cleaned.columns)
    assert D.repeated_passages(empty).count() == 0 and D.remove_passages(empty).count() == 0


def test_anchors_are_the_winnowing_guarantee():
    rng = np.random.default_rng(0)
    docs = np.repeat([0, 1, 2], [500, 20, 90])
    values = rng.integers(0, 1 << 62, len(docs), dtype=np.uint64)
    picked = D.anchors(docs, values, 35)
    for d in range(3):
        at = np.flatnonzero(docs == d)
        for a in range(max(1, len(at) - 34)):
            window = at[a : a + 35]
            assert window[values[window].argmin()] in picked


def test_windows_travel_as_stretches(spark, monkeypatch):
    """Windows of a document that touch are one row before they meet its runs, wherever the batches are cut."""
    rows, write = {}, D.materialise
    monkeypatch.setattr(D, "materialise", lambda df, label: rows.setdefault(label, write(df, label)))
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, f"before {text} after"), (3, f"{text} again")], "doc_id long, text string")
    assert D.repeated_passages(docs).where("removed").count() == 2
    windows = sorted(map(tuple, rows["passage-windows"].select("doc_id", "text_key", "removed", "word", "until").collect()))
    assert windows and all(a[:3] != b[:3] or b[3] > a[4] for a, b in zip(windows, windows[1:]))
    assert any(until - word > D.PARAGRAPH for *_, word, until in windows)
    rng = random.Random(5)
    places = sorted({(rng.randrange(3), rng.randrange(4), rng.random() < 0.5, rng.randrange(400)) for _ in range(300)})
    rows = [(None if d == 0 else d, t, r, w, 5 * w, 5 * w + 80, rng.choice([None, 1, 2]), rng.randrange(50)) for d, t, r, w in places for _ in range(rng.choice([1, 1, 2]))]
    names = ["doc_id", "text_key", "removed", "word", "start", "end", "keep", "window"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    want = []
    for row in rows:
        if not want or want[-1][0][:3] != row[:3] or row[3] - want[-1][-1][3] > D.PARAGRAPH:
            want.append([])
        want[-1].append(row)
    least = lambda values: min((v for v in values if v is not None), default=None)
    text = lambda v: "null" if v is None else str(v)
    want = [
        (*g[0][:4], g[-1][3] + D.PARAGRAPH, min(r[4] for r in g), max(r[5] for r in g), least(r[6] for r in g), {text(r[6]) for r in g}, min(r[7] for r in g), {r[7] for r in g})
        for g in want
    ]
    for size in (1, 7, 1000):
        cut = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + size]), types)], names) for a in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in D._stretches(iter(cut)) for r in b.to_pylist()]
        assert [(*g[:8], set(g[8]), g[9], set(g[10])) for g in got] == want
        assert all(len(g[8]) == len(set(g[8])) and len(g[10]) == len(set(g[10])) for g in got)


def test_spans_of_documents():
    rng = random.Random(6)
    spans = [[{"from": a, "until": a + rng.randrange(-3, 30)} for a in (rng.randrange(-40, 300) for _ in range(rng.randrange(6)))] for _ in range(20)]
    places = [(d, w) for d in range(20) for w in range(330)]
    column = pa.array([[]] + spans, pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32())]))).slice(1)
    got = D._inside(np.array([(d << 32) + w for d, w in places]), column)
    assert got.tolist() == [any(x["from"] <= w <= x["until"] for x in spans[d]) for d, w in places]


def test_jaccard_of_a_block():
    rng = np.random.default_rng(2)
    sets = np.sort(rng.integers(0, 30, (25, 12)).astype(np.uint32), 1)
    root = D.similar(sets, 0.5)
    as_sets = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(25) for j in range(25) if len(as_sets[i] & as_sets[j]) >= 0.5 * len(as_sets[i] | as_sets[j])]
    want = union(pairs)
    assert root.tolist() == [want[i] for i in range(25)]


def test_bands_reach_the_recall():
    b = D.bands_for(0.8, 0.98, 2)
    assert 1 - (1 - 0.8**2) ** b >= 0.98 > 1 - (1 - 0.8**2) ** (b - 1)


# --- what stays on the disks --------------------------------------------------------------


def test_no_bitmap_stays_on_a_disk(spark, monkeypatch):
    """A bitmap has the same size for every table, and every machine keeps a file of it until it is destroyed."""
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(send(value)) or sent[-1])
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, f"before {text} after"), (3, f"{text} again")], "doc_id long, text string")
    assert D.repeated_passages(docs).where("removed").count() == 2
    assert len(sent) == 3
    assert drop_near_copies(docs).count() == 1
    assert len(sent) == 4 and not [b for b in sent if os.path.exists(b._path)]
