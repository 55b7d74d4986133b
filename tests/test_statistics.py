"""Operators against brute force in numpy on small data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitscope.operators import agreement, geometry, ordered, patterns, proposers, sampling
from traitscope.operators.denote import distinct_denotation, to_long, token_matches
from traitscope.operators.embedders import HashedBowEmbedder, random_project
from traitscope.operators.passes import Held, Passes, Rows, Search, solve
from traitscope.plans import solvers

RNG = np.random.default_rng(3)


def den_frame(spark, phi, extra=None, ddl="", parts=3):
    rows = [(i, [int(v) for v in row], *([extra[i]] if extra is not None else [])) for i, row in enumerate(phi)]
    return spark.createDataFrame(rows, "text_id bigint, phi array<int>" + ddl).repartition(parts)


def cluster_loss(phi, smoothing=1.0):
    p = np.maximum(phi / (phi.sum(axis=0) + 1e-6), smoothing / len(phi)).max(axis=1)
    return -np.log(p).mean()


@pytest.mark.parametrize("parts", [1, 7])
def test_cluster_fitness(spark, parts):
    phi = (RNG.random((200, 4)) < [0.5, 0.2, 0.1, 0.02]).astype(int)
    table = patterns.pattern_counts(den_frame(spark, phi, parts=parts), 4)
    assert patterns.cluster_fitness(table, 4).first()["loss"] == pytest.approx(cluster_loss(phi), abs=1e-12)


def test_real_valued_patterns(spark):
    phi = np.round(RNG.random((60, 3)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(phi)], "text_id bigint, phi array<double>")
    table = patterns.pattern_counts(df, 3, binary=False)
    assert patterns.cluster_fitness(table, 3).first()["loss"] == pytest.approx(cluster_loss(phi), abs=1e-12)


def test_ablation_and_candidates(spark):
    phi = (RNG.random((150, 6)) < 0.3).astype(int)
    phi[:, 2] = phi[:, 0]
    table = patterns.pattern_counts(den_frame(spark, phi), 6)
    three = patterns.pattern_counts(den_frame(spark, phi[:, :3]), 3)
    got = {r["predicate_id"]: r for r in patterns.ablation_loss(three, 3).collect()}
    for k in range(3):
        cut = phi[:, :3].copy()
        cut[:, k] = 0
        assert got[k]["increase"] == pytest.approx(cluster_loss(cut) - cluster_loss(phi[:, :3]), abs=1e-12)
    assert [got[k]["has_twin"] for k in range(3)] == [True, False, True]
    assert sorted(got, key=lambda k: got[k]["place"]) == [0, 2, 1]
    losses = {r["variant"]: r["loss"] for r in patterns.candidate_losses(table, 3, 1, 3).collect()}
    for j in range(3):
        swapped = phi[:, :3].copy()
        swapped[:, 1] = phi[:, 3 + j]
        assert losses[j] == pytest.approx(cluster_loss(swapped), abs=1e-12)


def test_correlation_of_constant_is_zero(spark):
    phi = np.column_stack([np.ones(50, int), RNG.integers(0, 2, 50)])
    y = RNG.normal(size=50)
    df = den_frame(spark, phi, [float(v) for v in y], ", y double")
    got = {r["predicate_id"]: r["correlation"] for r in patterns.predicate_correlation(df, 2, "y").collect()}
    assert got[0] == 0.0
    assert got[1] == pytest.approx(np.corrcoef(phi[:, 1], y)[0, 1], abs=1e-12)


def smooth(x, rate, seed_n):
    c = [np.mean(x[:seed_n])]
    for v in x[1:]:
        c.append((1 - rate) * c[-1] + rate * v)
    return np.array(c)


@pytest.mark.parametrize("n,parts", [(3, 2), (40, 1), (3000, 5)])
@pytest.mark.parametrize("rate", [0.05, 0.8, 1.0, 0.0])
def test_ema_matches_the_recursion(spark, n, parts, rate):
    x = RNG.random((n, 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "t0 bigint, x array<double>").repartition(parts)
    got = ordered.ema_curve(df, ["t0"], "x", rate, 50).orderBy("t").toPandas()
    want = np.column_stack([smooth(x[:, j], rate, 50) for j in range(2)])
    assert list(got["t"]) == list(range(n)) == list(got["t0"])
    np.testing.assert_allclose(np.stack(got["curve"]), want, atol=1e-10)


def test_large_scores_do_not_overflow():
    """Scores of any size give finite totals and the plain assignment."""
    from traitscope.operators.passes import Rows
    from traitscope.plans import solvers

    phi = RNG.random((50, 3)) * 90
    rows = Rows(np.zeros((50, 0)), phi, np.zeros(50, np.int64), np.ones(50))
    top = solvers.live_bound(phi.max(axis=0), 3, ())
    totals = solvers.column_totals((), np.zeros((0, 0)), 0.1, top)(rows)
    assert np.isfinite(totals).all() and (totals > 0).all()
    got = solvers.assigned(rows, (), np.zeros((0, 0)), np.log(totals), top, 0.1)
    z = np.max(phi / 0.1, axis=0) + np.log(np.exp(phi / 0.1 - np.max(phi / 0.1, axis=0)).sum(axis=0))
    assert (got == np.argmax(phi / 0.1 - z, axis=1)).all()


def test_permutation_band(spark):
    import hashlib

    x = RNG.random(200)
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "t bigint, curve array<double>")
    got = ordered.permutation_band(df, rate=0.05, seed_n=10, reps=7, seed=4).first()
    lows, highs = [1.0], [0.0]
    for rep in range(7):
        order = sorted(range(200), key=lambda t: hashlib.md5(f"4:{rep}:{t}".encode()).hexdigest())
        c = smooth(x[order], 0.05, 10)
        lows.append(c.min())
        highs.append(c.max())
    assert got["lower"] == pytest.approx(min(lows), abs=1e-10)
    assert got["upper"] == pytest.approx(max(highs), abs=1e-10)


def test_numbering_with_one_hot_time(spark):
    """A third of the rows share one time: the unique last key still spreads them."""
    rows = [(0 if i % 3 == 0 else i, i) for i in range(900)]
    df = spark.createDataFrame(rows, "ts bigint, id bigint").repartition(6)
    placed, total = ordered.number_rows(df, ["ts", "id"])
    assert total == 900
    want = {r: t for t, r in enumerate(sorted(rows))}
    assert {(r["ts"], r["id"]): r["t"] for r in placed.collect()} == want


def test_auc_and_percentiles(spark):
    y, s = RNG.integers(0, 2, 300), RNG.integers(0, 12, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert agreement.auc_roc(df, "y", "s").first()["auc"] == pytest.approx(np.mean(pairs), abs=1e-12)
    points = [0, 11.1, 50, 77.7, 100]
    assert ordered.exact_percentiles(df, "s", points) == pytest.approx(list(np.percentile(s, points)))
    best = 0.0
    for q in np.linspace(0, 100, 10):
        p = s >= np.percentile(s, q)
        best = max(best, 2 * (p & (y == 1)).sum() / (p.sum() + y.sum()))
    assert agreement.best_threshold_f1(df, "y", "s").first()["best_f1"] == pytest.approx(best, abs=1e-12)


def test_auc_without_a_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert agreement.auc_roc(df, "y", "s").first()["auc"] is None


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_assignment_is_the_best(k):
    for _ in range(20):
        gain = RNG.integers(0, 30, (k, k)).astype(float)
        match = agreement.best_assignment(gain)
        assert sorted(match) == list(range(k))
        best = max(sum(gain[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        assert sum(gain[i, match[i]] for i in range(k)) == best


def test_matched_metrics_real_valued(spark):
    ref = np.eye(3, dtype=int)[RNG.integers(0, 3, 90)]
    pred = ref[:, [1, 2, 0]].astype(float)
    pred[:, 0] = pred[:, 0] * 0.5 + RNG.random(90) * 0.3
    rows = [(i, [int(v) for v in r], [float(v) for v in p]) for i, (r, p) in enumerate(zip(ref, pred))]
    both = spark.createDataFrame(rows, "text_id bigint, ref array<int>, pred array<double>")
    got = {r["ref_id"]: r for r in agreement.matched_metrics(both, 3).collect()}
    assert {k: r["pred_id"] for k, r in got.items()} == {1: 0, 2: 1, 0: 2}
    assert got[0]["f1"] == 1.0 and got[1]["f1"] == 0.0 and got[1]["auc"] == 1.0


def test_token_scores_and_matches(spark):
    texts = ["a a b", "b c", "c", "a"]
    y = [1.0, 0.0, 2.0, 5.0]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, y))], "text_id bigint, text string, y double")
    centred = np.array(y) - np.mean(y)
    want = {w: sum(t.split().count(w) * c for t, c in zip(texts, centred)) for w in "abc"}
    got = {r["predicate"]: r["score"] for r in proposers.token_scores(df, "y").collect()}
    assert got == pytest.approx(want)
    names = spark.createDataFrame([(0, "a"), (1, "c"), (2, "zz")], "predicate_id int, predicate string")
    hits = {(r["text_id"], r["predicate_id"]) for r in token_matches(df, names).collect()}
    wide = {(r["text_id"], r["predicate_id"]) for r in to_long(distinct_denotation(df, ["a", "c", "zz"])).filter("value = 1").collect()}
    assert hits == wide


def test_sample_bound_changes_nothing(spark):
    df = spark.range(50000).withColumnRenamed("id", "text_id")
    a = sampling.sample_ids(df, 20, 5).collect()
    b = sampling.sample_ids(df, 20, 5, total=50000).collect()
    c = sampling.sample_ids(df, 20, 5, total=500000000).collect()
    assert a == b == c


def test_embedding_and_projection(spark):
    df = spark.createDataFrame([(0, "x y"), (1, "y x"), (2, "")], "text_id bigint, text string")
    got = {r["text_id"]: np.array(r["embedding"]) for r in HashedBowEmbedder().embed(df).collect()}
    np.testing.assert_array_equal(got[0], got[1])
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6) and not got[2].any()
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "text_id bigint, embedding array<double>")
    p = np.stack([r["projected"] for r in random_project(v, 4, 2).orderBy("text_id").collect()])
    np.testing.assert_allclose(np.linalg.norm(p, axis=0), 1)


def test_centroid_of_an_empty_group_is_a_text(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], "text_id bigint, embedding array<double>, g int")
    m = geometry.centroid_matrix(v, 2, "g")
    np.testing.assert_allclose(m[0], [2, 1])
    assert m[1, 1] == 1 and m[1, 0] in range(5)


def test_kmeanspp_spreads(spark):
    points = [[0.0, 0.0]] * 50 + [[10.0, 0.0]] + [[0.0, 10.0]]
    v = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "text_id bigint, embedding array<double>")
    rows = geometry.kmeanspp_seed(v, 3, seed=2).collect()
    assert len({tuple(r["embedding"]) for r in rows}) == 3


def numeric_gradient(loss, x, h=1e-6):
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        e = np.zeros_like(x)
        e[i] = h
        g[i] = (loss(x + e) - loss(x - e)) / (2 * h)
    return g


def held(phi, y=None, x=None, weight=None):
    n = len(phi)
    return Held(Rows(np.zeros((n, 0)) if x is None else x, np.asarray(phi, float), np.zeros(n, int) if y is None else y, np.ones(n) if weight is None else weight))


def test_label_weights_reach_a_stationary_point():
    phi = (RNG.random((120, 3)) < 0.4).astype(float)
    y = RNG.integers(0, 3, 120)
    ((w, loss),) = solve(held(phi, y), [solvers.label_weights(3, 3, 120.0)])

    def objective(w):
        z = phi @ w
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(120), y]).mean() + (w**2).sum() / (2 * 1e5 * 120)

    assert np.abs(numeric_gradient(objective, w)).max() < 1e-5
    assert loss == pytest.approx(objective(w), abs=1e-6)


def test_label_weights_many_classes_agree(monkeypatch):
    phi = (RNG.random((80, 2)) < 0.4).astype(float)
    y = RNG.integers(0, 4, 80)
    ((_, a),) = solve(held(phi, y), [solvers.label_weights(2, 4, 80.0)])
    monkeypatch.setattr(solvers, "WIDE", 0)
    ((_, b),) = solve(held(phi, y), [solvers.label_weights(2, 4, 80.0)])
    assert a == pytest.approx(b, abs=1e-6)


def series_loss(w, phi, lam):
    logits = w @ phi.T
    top = logits.max(axis=1, keepdims=True)
    log_p = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    return -np.diag(log_p).mean() + lam * ((w[1:] - w[:-1]) ** 2).mean()


def test_series_weights_solve_the_full_problem():
    """One bucket per text and pattern counts give the loss of the full T x T softmax."""
    n = 30
    phi = (np.arange(n)[:, None] > [8, 20]).astype(float)
    phi = np.where(RNG.random((n, 2)) < 0.2, 1 - phi, phi)
    bits, counts = np.unique(phi, axis=0, return_counts=True)
    ((w, loss),) = solve(held(bits, weight=counts.astype(float)), [solvers.series_weights(2, np.ones(n), phi, 1.0)])
    assert loss == pytest.approx(series_loss(w, phi, 1.0), abs=1e-10)
    assert np.abs(numeric_gradient(lambda v: series_loss(v, phi, 1.0), w)).max() < 1e-5
    assert loss < series_loss(np.zeros((n, 2)), phi, 1.0)


def test_passes_agree_with_one_batch(spark):
    """Sums over a table do not depend on its partitions, nor on the second adding stage."""
    from traitscope.operators import passes

    x = RNG.normal(size=(97, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "text_id bigint, embedding array<double>, y int")
    kernel = geometry.member_sums(4)
    want = kernel(Rows(x, np.zeros((97, 0)), np.arange(97) % 4, np.ones(97)))
    for parts in (1, 6, 300):
        np.testing.assert_allclose(Passes(df.repartition(parts)).sums([kernel, kernel])[1], want, atol=1e-9)
    assert passes.DIRECT < 300


def test_refined_centres_are_local_optima():
    x = RNG.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = RNG.integers(0, 2, 60)
    hot = lambda rows: ((rows.y[:, None] == np.arange(2)).astype(float), 0.0)
    start = np.stack([x[y == k].mean(axis=0) for k in range(2)])
    solver = solvers.refine_centres(start, hot, 1 / 60, 0.5, gain=1e-10)
    ((u, _),) = solve(held(np.zeros((60, 2)), y, x), [solver])

    def loss(c):
        c = c / np.linalg.norm(c, axis=1, keepdims=True)
        z = c @ x.T / 0.5
        p = np.maximum(np.exp(z) / np.exp(z).sum(axis=1, keepdims=True), 1 / 60)
        return -np.mean([np.log(p[k, i]) for i, k in enumerate(y)])

    assert loss(u) <= loss(start)
    around = [loss(u + 0.02 * RNG.normal(size=u.shape)) for _ in range(30)]
    assert loss(u) <= min(around) + 1e-3


def test_missing_text_has_no_tokens(spark):
    df = spark.createDataFrame([(0, None), (1, "a")], "text_id bigint, text string")
    got = {r["text_id"]: np.array(r["embedding"]) for r in HashedBowEmbedder().embed(df).collect()}
    assert not got[0].any() and got[1].any()
    bits = {r["text_id"]: list(r["phi"]) for r in distinct_denotation(df, ["a"]).collect()}
    assert bits == {0: [0], 1: [1]}


def test_hot_copies_change_nothing(spark):
    """A third of the rows are one text, another third share one label and time."""
    from traitscope.operators.texts import dedup_last_label, dedup_texts, scatter_back, text_key

    texts = ["hot text"] * 300 + [f"t{i} hot" for i in range(300)] + [f"u{i % 50}" for i in range(300)]
    rows = [(i, t, 0 if i < 600 else i % 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "text_id bigint, text string, label int").repartition(8)
    assert dedup_texts(df).count() == len(set(texts))
    den = distinct_denotation(df, ["hot", "text"])
    counts = {tuple(r["phi"]): r["cnt"] for r in patterns.pattern_counts(den, 2).collect()}
    assert counts == {(1, 1): 1, (1, 0): 300, (0, 0): 50}
    firsts = {t: i for i, t in reversed(list(enumerate(texts)))}
    lasts = {t: row[2] for t, row in zip(texts, rows)}
    got = {r["text"]: (r["text_id"], r["label"]) for r in dedup_last_label(df, "text_id", "label").collect()}
    assert got == {t: (firsts[t], lasts[t]) for t in set(texts)}
    keyed = dedup_texts(df).select(text_key("text").alias("text_key"), F.col("text_id").alias("first"))
    back = scatter_back(df, keyed).select("text_id", "first").collect()
    assert {r["text_id"]: r["first"] for r in back} == {i: firsts[t] for i, t in enumerate(texts)}


def test_searches_inside_tasks_equal_passes(spark):
    x = RNG.normal(size=(120, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(x[i].tolist(), [float(b) for b in RNG.random(3) < 0.4], int(i % 2)) for i in range(120)]
    table = spark.createDataFrame(rows, "embedding array<double>, phi array<double>, y int").repartition(3)
    searches = [
        Search(solvers.cluster_directions, 3, [k], x[:3], None, 120, 1.0, 0.1) for k in (0, 1)
    ] + [Search(solvers.class_directions, 3, [2], x[:3], None, 120, 2)]
    apart = solve(Passes(table, 120), searches)
    together = solve(Passes(table), searches)
    for a, b in zip(apart, together):
        np.testing.assert_allclose(a, b, atol=1e-6)


def test_searches_end_where_nothing_moves():
    """On groups that are apart, a search started from its own result stays there."""
    centres = np.eye(5)[:3]
    x = centres[np.arange(210) % 3] + 0.15 * RNG.normal(size=(210, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    source = held(np.zeros((210, 3)), x=x)
    (a,) = solve(source, [solvers.cluster_directions(3, [0, 1, 2], x[:3], x[:3], 210, 1.0, 0.1)])
    (b,) = solve(source, [solvers.cluster_directions(3, [0, 1, 2], x[:3], a, 210, 1.0, 0.1)])
    assert (a * b).sum(axis=1).min() > 0.998
    assert [int(np.argmax(c)) for c in a] == [int(np.argmax(c)) for c in x[:3]]


def searched_table(spark, n=120):
    x = RNG.normal(size=(n, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(x[i].tolist(), [float(b) for b in RNG.random(3) < 0.4], int(i % 2)) for i in range(n)]
    return x, spark.createDataFrame(rows, "embedding array<double>, phi array<double>, y int")


def test_held_rows_give_the_sums_of_the_table(spark):
    """Many partitions are added up in stages; a search leaves nothing behind."""
    from traitscope.operators import passes

    x, table = searched_table(spark)
    kernel = lambda rows: np.concatenate([rows.x.T @ rows.phi, rows.y.sum() + rows.weight.sum() + np.zeros((1, 3))]).ravel()
    for parts in (3, passes.GATHER + 60):
        source = Passes(table.repartition(parts))
        want = source.sums([kernel, kernel])
        source.hold()
        for a, b in zip(source.sums([kernel, kernel]), want):
            np.testing.assert_allclose(a, b, atol=1e-9)
        source.release()
        assert source.held is None
    source = Passes(table.repartition(3))
    solve(source, [solvers.cluster_directions(3, [0], x[:3], None, 120, 1.0, 0.1)])
    assert source.held is None


def test_a_light_search_is_one_job_beyond_the_rows_of_a_node(spark, monkeypatch):
    """A search of clusters takes hundreds of passes: over a table that a task can hold, it starts none."""
    from traitscope.operators import passes

    x, table = searched_table(spark)
    args = (solvers.cluster_directions, 3, [0], x[:3], None, 120, 1.0, 0.1)
    together = solve(Passes(table), [Search(*args)])
    monkeypatch.setattr(passes, "NODE", 100)
    monkeypatch.setattr(Passes, "sums", lambda *_: pytest.fail("a pass"))
    np.testing.assert_allclose(solve(Passes(table, 120), [passes.LightSearch(*args)])[0], together[0], atol=1e-6)
    assert passes.LightSearch(*args).fits(50_000, 53) and not passes.LightSearch(*args).fits(500_000, 53)
    assert not Search(*args).fits(50_000, 53)


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """Embedders and batch functions get batches of bounded bytes; vectors do not depend on the parts of a batch."""
    from traitscope.operators import embedders, scorers
    from traitscope.session import BATCH_SETTING, bound_batches

    texts = spark.range(1100).selectExpr("id AS text_id", "concat('w', id % 7, ' ', repeat(concat('v', id, ' '), cast(id % 5 AS int))) AS text")
    found = []
    for parts in (1, 40):
        spark.conf.unset(BATCH_SETTING)
        embedded = HashedBowEmbedder().embed(texts.repartition(parts))
        assert spark.conf.get(BATCH_SETTING) == "4m"
        found.append(np.array([r["embedding"] for r in embedded.orderBy("text_id").collect()]))
    np.testing.assert_array_equal(*found)
    assert embedders.PART < 1100
    spark.conf.unset(BATCH_SETTING)
    scorers.BatchScorer(lambda batch: [0.0] * len(batch), "none").score_pairs(texts.withColumn("predicate", F.lit("a")))
    assert spark.conf.get(BATCH_SETTING) == "4m"
    bound_batches(spark)
