"""Weights per text against the dense softmax over all texts, on one driver and in written runs."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from traitscope.plans import series

RNG = np.random.default_rng(11)


def dense_loss(w, phi, lam):
    logits = w @ phi.T
    top = logits.max(axis=1, keepdims=True)
    log_p = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    return -np.diag(log_p).mean() + lam * ((w[1:] - w[:-1]) ** 2).mean()


def bits_of(n, k=2):
    phi = (np.arange(n)[:, None] > np.linspace(n / 3, n / 1.5, k)).astype(int)
    return np.where(RNG.random((n, k)) < 0.2, 1 - phi, phi)


def table(spark, phis):
    rows = [(v, [int(b) for b in p], t, 1) for v, phi in enumerate(phis) for t, p in enumerate(phi)]
    return spark.createDataFrame(rows, "variant int, phi array<int>, y long, cnt long")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101])
def test_chains_by_odd_even_reduction(n):
    k, b = 3, RNG.random((n, 3, 3)) + 6 * np.eye(3)
    a, c, r = RNG.random((n, k, k)), RNG.random((n, k, k)), RNG.random((n, k, 2))
    a[0], c[-1] = 0, 0
    full = np.zeros((n * k, n * k))
    for i in range(n):
        full[i * k : i * k + k, i * k : i * k + k] = b[i]
        if i:
            full[i * k : i * k + k, i * k - k : i * k] = -a[i]
        if i < n - 1:
            full[i * k : i * k + k, i * k + k : i * k + 2 * k] = -c[i]
    want = np.linalg.solve(full, r.reshape(n * k, 2)).reshape(n, k, 2)
    np.testing.assert_allclose(series.solve_chain(a, b, c, r), want, atol=1e-9)


@pytest.mark.parametrize("n, block", [(1, 4), (40, 64), (40, 8), (41, 8), (33, 32), (7, 1)])
def test_equal_to_the_dense_loss_in_any_cut(spark, monkeypatch, n, block):
    monkeypatch.setattr(series, "BLOCK", block)
    phi = bits_of(n)
    source, loss = series.series_path(table(spark, [phi]), 2, 1.0, n)
    w = np.concatenate([run.w for run in source.runs[0]])
    assert w.shape == (n, 2)
    if n == 1:
        assert loss[0] == pytest.approx(0.0)
        return
    assert loss[0] == pytest.approx(dense_loss(w, phi, 1.0), abs=1e-11)
    for i in range(0, n, max(n // 7, 1)):
        for j in range(2):
            up, down = w.copy(), w.copy()
            up[i, j] += 1e-5
            down[i, j] -= 1e-5
            assert abs(dense_loss(up, phi, 1.0) - dense_loss(down, phi, 1.0)) < 2e-11
    assert loss[0] < dense_loss(np.zeros((n, 2)), phi, 1.0)


def test_written_runs_agree_with_the_driver(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 16)
    phis = [bits_of(70), bits_of(70), np.zeros((70, 2), dtype=int)]
    df = table(spark, phis)
    here, a = series.series_path(df, 2, 0.5, 70)
    there, b = series.series_path(df, 2, 0.5, 70, held=0)
    assert isinstance(there, series.WrittenRuns) and a == pytest.approx(b, abs=1e-12)
    for v in range(3):
        x = [r["w"] for r in series.path_weights(here, spark, v).orderBy("t").collect()]
        rows = series.path_weights(there, spark, v).orderBy("t").collect()
        assert [r["t"] for r in rows] == list(range(70))
        np.testing.assert_allclose(x, [r["w"] for r in rows], atol=1e-9)


def test_steps_that_are_too_long_are_halved(spark, monkeypatch):
    """A weak penalty and rare patterns make the first full steps overshoot."""
    monkeypatch.setattr(series, "BLOCK", 8)
    phi = np.zeros((60, 2), dtype=int)
    phi[[5, 6, 40], 0] = 1
    phi[::2, 1] = 1
    df = table(spark, [phi, bits_of(60)])
    here, a = series.series_path(df, 2, 1e-3, 60)
    there, b = series.series_path(df, 2, 1e-3, 60, held=0)
    assert a == pytest.approx(b, abs=1e-9)
    w = np.concatenate([run.w for run in here.runs[0]])
    assert a[0] == pytest.approx(dense_loss(w, phi, 1e-3), abs=1e-10)


def test_places_with_several_texts_or_none(spark, monkeypatch):
    rows = [(0, [1, 0], 0, 3), (0, [0, 1], 0, 2), (0, [0, 1], 4, 1), (0, [1, 1], 9, 2)]
    df = spark.createDataFrame(rows, "variant int, phi array<int>, y long, cnt long")
    _, whole = series.series_path(df, 2, 1.0, 12)
    monkeypatch.setattr(series, "BLOCK", 3)
    _, cut = series.series_path(df, 2, 1.0, 12)
    _, written = series.series_path(df, 2, 1.0, 12, held=0)
    assert whole[0] == pytest.approx(cut[0], abs=1e-12) and whole[0] == pytest.approx(written[0], abs=1e-12)


def test_no_jump_at_any_number_of_texts(spark):
    """The loss of a series is about the same with one text more, at every size."""
    phi = bits_of(520)
    losses = [series.series_path(table(spark, [phi[:n]]), 2, 1.0, n)[1][0] - np.log(n) for n in (511, 512, 513, 514)]
    assert max(losses) - min(losses) < 0.01


@pytest.mark.parametrize("n, k", [(1, 2), (2, 1), (3, 2), (64, 4), (101, 3)])
def test_linked_places_by_whole_vectors(n, k):
    q = RNG.random((n, k, k))
    diagonal, r = q @ q.transpose(0, 2, 1) + 1.5 * np.eye(k), RNG.random((n, k, 1 + 2 * k))
    side = np.broadcast_to(0.7 * np.eye(k), diagonal.shape).copy()
    a, c = side, side.copy()
    a[0], c[-1] = 0, 0
    np.testing.assert_allclose(series.solve_linked(diagonal, 0.7, r), series.solve_chain(a, diagonal, c, r), atol=1e-10)


def test_a_long_run_is_solved_in_few_operations(monkeypatch):
    """No matrix of a place is inverted or multiplied by itself: that took most of a fit's time."""
    monkeypatch.setattr(np.linalg, "inv", lambda b: pytest.fail(f"{len(b)} inverses, one by one"))
    n = 4096
    x = series.solve_linked(np.broadcast_to(3 * np.eye(2), (n, 2, 2)), 1.0, np.ones((n, 2, 1)))
    assert np.allclose(x[n // 2], 1.0)


def test_memory_of_a_task_does_not_grow_with_its_runs(monkeypatch):
    """A task of many runs holds the numbers of one run besides its batch."""
    monkeypatch.setattr(series, "BLOCK", 1000)

    def peak(runs: int) -> int:
        places = [[{"y": 1000 * b + i, "n": 1.0, "sums": [1.0, 0.0]} for i in range(1000)] for b in range(runs)]
        kind = pa.list_(pa.struct([("y", pa.int64()), ("n", pa.float64()), ("sums", pa.list_(pa.float64()))]))
        columns = [pa.array([0] * runs), pa.array(range(runs)), pa.array([1000] * runs), pa.array(places, kind)]
        batch = pa.RecordBatch.from_arrays(columns, ["variant", "block", "count", "places"])
        del places
        tracemalloc.start()
        for row in series._block_rows(2)(iter([batch])):
            assert row.column(2)[0].as_py() == [1.0] * 1000 and row.column(3)[0].as_py()[:2] == [1.0, 0.0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(24) < 1.5 * peak(2)
