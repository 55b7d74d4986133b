"""What the fits and bands do on long tables, on rows of their own."""

import hashlib

import numpy as np
import pytest

from traitscope.operators import ordered, passes
from traitscope.operators.passes import Held, LightSearch, Passes, Rows, Search, pieces, solve
from traitscope.plans import solvers

RNG = np.random.default_rng(11)


def made_rows(n, d=6, k=3):
    x = solvers.unit(RNG.normal(size=(n, d))).astype(np.float32)
    return Rows(x, RNG.integers(0, 2, (n, k)), np.zeros(n, np.int64), np.ones(n))


def test_a_light_search_of_a_gigabyte_of_texts_runs_in_a_task():
    assert LightSearch(solvers.cluster_directions).fits(472_152, 54)
    assert not LightSearch(solvers.cluster_directions).fits(3_000_000, 54)
    assert not Search(solvers.class_directions).fits(500_000, 54)


def test_kernels_see_pieces_as_doubles():
    rows = made_rows(2 * passes.PIECE + 3)
    parts = list(pieces(rows))
    assert [len(p.y) for p in parts] == [passes.PIECE, passes.PIECE, 3]
    assert all(p.x.dtype == p.phi.dtype == np.float64 for p in parts)
    np.testing.assert_array_equal(np.concatenate([p.x for p in parts]), rows.x)
    (total,) = Held(rows).sums([lambda r: r.x.sum(axis=0)])
    np.testing.assert_allclose(total, rows.x.astype(float).sum(axis=0), atol=1e-9)


def test_members_are_assigned_once_per_refinement(monkeypatch):
    """Not at each of the passes of a refinement: rows that stay with the search remember them."""
    rows, calls, asked = made_rows(passes.PIECE // 2), [], []
    plain = solvers.assigned
    monkeypatch.setattr(solvers, "assigned", lambda *a: calls.append(1) or plain(*a))
    held = Held(rows)
    search = solvers.cluster_directions(3, [1], solvers.unit(rows.x[:3].astype(float)), None, len(rows.y), 1.0, 0.1)
    value = None
    try:
        while True:
            kernel = search.send(value)
            asked.append(1)
            (value,) = held.sums([kernel])
    except StopIteration:
        pass
    assert len(calls) <= 2 * solvers.ROUNDS + 2 < len(asked)


def test_remembered_members_do_not_change_a_search(spark):
    rows = made_rows(300)
    search = lambda: solvers.cluster_directions(3, [1], solvers.unit(rows.x[:3].astype(float)), None, 300, 1.0, 0.1)

    class Forgetful(Held):
        def sums(self, kernels):
            self.memos = [{} for _ in self.memos]
            return super().sums(kernels)

    (kept,), (forgot,) = solve(Held(rows), [search()]), solve(Forgetful(rows), [search()])
    np.testing.assert_array_equal(kept, forgot)
    df = spark.createDataFrame([([float(v) for v in x], [int(b) for b in p]) for x, p in zip(rows.x, rows.phi)], "embedding array<float>, phi array<int>").coalesce(1)
    (held,) = solve(Passes(df), [search()])
    np.testing.assert_allclose(held, kept, atol=1e-9)


def band_by_hand(x, rate, seed_n, reps, seed):
    lows, highs = [1.0], [0.0]
    for rep in range(reps):
        order = sorted(range(len(x)), key=lambda t: hashlib.md5(f"{seed}:{rep}:{t}".encode()).hexdigest())
        c = [np.mean(x[order[:seed_n]])]
        for v in x[order[1:]]:
            c.append((1 - rate) * c[-1] + rate * v)
        lows.append(min(c))
        highs.append(max(c))
    return min(lows), max(highs)


@pytest.mark.parametrize("rate", [0.05, 1e-3, 0.0, 1.0])
def test_a_band_is_shuffled_a_few_repetitions_at_a_time(spark, monkeypatch, rate):
    """Disk holds ``SHUFFLED`` rows at most, none of them smoothed."""
    x = RNG.normal(size=300)
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "t bigint, curve array<double>").repartition(3)
    written, plain, cleanup = [], ordered.materialise, spark.conf.get(ordered.CLEANUP, None)
    monkeypatch.setattr(ordered, "SHUFFLED", 700)
    monkeypatch.setattr(ordered, "materialise", lambda table, label: written.append((label, plain(table, label).count())) or plain(table, label))
    got = ordered.permutation_band(df, rate=rate, seed_n=10, reps=5, seed=4).first()
    assert [label for label, _ in written] == ["band"] * 3
    assert all(rows <= 4 + 2 for _, rows in written)
    low, high = band_by_hand(x, rate, 10, 5, 4)
    assert got["lower"] == pytest.approx(low, abs=1e-9)
    assert got["upper"] == pytest.approx(high, abs=1e-9)
    assert spark.conf.get(ordered.CLEANUP, None) == cleanup


@pytest.mark.parametrize("hull", [1, 10_000])
@pytest.mark.parametrize("value", [lambda f, n: 0.7 * (1 - f), lambda f, n: RNG.normal(size=n), lambda f, n: np.zeros(n)])
def test_least_lines_hold_the_least_for_every_state(monkeypatch, hull, value):
    monkeypatch.setattr(ordered, "HULL", hull)
    for n in (1, 2, 400):
        at = np.arange(n)
        fade = 0.9**at
        v = value(fade, n)
        kept = ordered.least_lines(at, v, fade, 2.0)
        for s in np.linspace(-2, 2, 41):
            assert (v + s * fade)[kept].min() == pytest.approx((v + s * fade).min(), abs=1e-12)


def test_a_band_of_no_rows_and_of_missing_values(spark):
    schema = "t bigint, curve array<double>"
    assert ordered.permutation_band(spark.createDataFrame([], schema), reps=2).collect() == []
    rows = [(i, [0.5, None if i == 3 else 2.0]) for i in range(50)]
    first, second = ordered.permutation_band(spark.createDataFrame(rows, schema), reps=2, seed_n=5).orderBy("curve_id").collect()
    assert (first["lower"], first["upper"]) == (pytest.approx(0.5), pytest.approx(0.5))
    assert second["lower"] <= 1.0 and np.isnan(second["upper"])
