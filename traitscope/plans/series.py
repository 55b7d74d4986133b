"""One weight vector per text of a time series, at any length.

The loss is the mean of -log softmax over all texts, of the text at each place, plus ``penalty``
times the mean squared jump between the weights of neighbouring places. Scores of 0 and 1 make the
softmax's sum one over at most 2^k patterns, so a place needs its own size and sums only, and the
loss is convex with block tridiagonal second derivatives: one k x k block per place.

Newton's steps are solved in pieces. The places are cut into runs of ``BLOCK``. A run solves its own
system by odd-even reduction, for its gradient and for unit moves of the two places next to it; what
is left couples only the first and last places of the runs, 2 k unknowns for each, and is solved
on the driver. Then every run fills in its places. A step is one pass over a written table with one
row per run: it moves the weights, and eliminates again at the new point. The same functions run on the
driver where all places together are at most ``HELD`` numbers; the answer is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, discard, materialise

BLOCK = 16_384
HELD = 1 << 21
CELLS = 1 << 22  # numbers of a softmax that are held at once
TOLERANCE = 1e-12
TASKS = 2  # tasks per core that a written table of runs is dealt to


# --- linear systems ------------------------------------------------------------------------


def solve_chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with ``b[i] x[i] = r[i] + a[i] x[i-1] + c[i] x[i+1]``, by odd-even reduction; a[0] and c[-1] are zero."""
    n = len(b)
    if n == 1:
        return np.linalg.solve(b, r)
    inverse = np.linalg.inv(b[1::2])
    left, right, own = inverse @ a[1::2], inverse @ c[1::2], inverse @ r[1::2]
    odd, a2, b2, c2, r2 = len(left), np.zeros_like(a[::2]), b[::2].copy(), np.zeros_like(c[::2]), r[::2].copy()
    before = a[::2][1:]
    b2[1:] -= before @ right[: len(before)]
    r2[1:] += before @ own[: len(before)]
    a2[1:] = before @ left[: len(before)]
    after = c[::2][:odd]
    b2[:odd] -= after @ left
    r2[:odd] += after @ own
    c2[:odd] = after @ right
    even = solve_chain(a2, b2, c2, r2)
    x = np.empty_like(r)
    x[::2] = even
    x[1::2] = own + left @ even[:odd]
    inner = len(even) - 1
    x[1::2][:inner] += right[:inner] @ even[1 : inner + 1]
    return x


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ijn,jkn->ikn", x, y)


def _inverses(b: np.ndarray) -> np.ndarray:
    """Inverses of positive definite blocks (k x k x n), whose pivots are positive in any order."""
    out = b.copy()
    for p in range(len(b)):
        pivot = 1 / out[p, p]
        row, column = out[p] * pivot, out[:, p].copy()
        out -= column[:, None] * row
        out[p] = row
        out[:, p] = -column * pivot
        out[p, p] = pivot
    return out


def _reduce(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``solve_chain`` for positive definite systems whose places lie along the last axis."""
    if b.shape[-1] == 1:
        return _times(_inverses(b), r)
    inverse = _inverses(b[..., 1::2])
    left, right, own = (_times(inverse, x[..., 1::2]) for x in (a, c, r))
    odd, a2, b2, c2, r2 = left.shape[-1], np.zeros_like(a[..., ::2]), b[..., ::2].copy(), np.zeros_like(c[..., ::2]), r[..., ::2].copy()
    before = a[..., 2::2]
    inner = before.shape[-1]
    b2[..., 1:] -= _times(before, right[..., :inner])
    r2[..., 1:] += _times(before, own[..., :inner])
    a2[..., 1:] = _times(before, left[..., :inner])
    after = c[..., : 2 * odd : 2]
    b2[..., :odd] -= _times(after, left)
    r2[..., :odd] += _times(after, own)
    c2[..., :odd] = _times(after, right)
    even = _reduce(a2, b2, c2, r2)
    x = np.empty_like(r)
    x[..., ::2] = even
    x[..., 1::2] = own + _times(left, even[..., :odd])
    x[..., 1::2][..., :inner] += _times(right[..., :inner], even[..., 1:])
    return x


def solve_linked(diagonal: np.ndarray, link: float, r: np.ndarray) -> np.ndarray:
    """x with ``diagonal[i] x[i] = r[i] + link (x[i-1] + x[i+1])``; the whole system is positive definite.

    A step of the reduction is arithmetic on whole vectors, one for each cell of the blocks.
    """
    n, k = diagonal.shape[:2]
    a = np.zeros((k, k, n))
    a[np.arange(k), np.arange(k)] = link
    c = a.copy()
    a[..., 0], c[..., -1] = 0, 0
    lanes = [np.ascontiguousarray(x.transpose(1, 2, 0)) for x in (diagonal, r)]
    return np.ascontiguousarray(_reduce(a, lanes[0], c, lanes[1]).transpose(2, 0, 1))


# --- one run of places ---------------------------------------------------------------------


@dataclass
class Problem:
    """What all runs share: patterns with counts, places, size of the penalty."""

    phi: np.ndarray
    counts: np.ndarray
    total: float
    places: int
    penalty: float

    @property
    def link(self) -> float:
        return 2 * self.penalty / self.joint

    @property
    def joint(self) -> int:
        return max((self.places - 1) * self.phi.shape[1], 1)


@dataclass
class Run:
    sizes: np.ndarray
    sums: np.ndarray
    w: np.ndarray


def terms(run: Run, problem: Problem):
    """Loss, gradient and second derivatives of a run's places, without the penalty."""
    n, k = run.w.shape
    mean, second, logz = np.empty((n, k)), np.empty((n, k, k)), np.empty(n)
    pairs = (problem.phi[:, :, None] * problem.phi[:, None, :]).reshape(len(problem.phi), -1)
    base, step = np.log(problem.counts), max(1, CELLS // len(problem.phi))
    for i in range(0, n, step):
        logits = run.w[i : i + step] @ problem.phi.T + base
        top = logits.max(axis=1, keepdims=True)
        e = np.exp(logits - top)
        z = e.sum(axis=1, keepdims=True)
        logz[i : i + step] = (np.log(z) + top)[:, 0]
        mean[i : i + step] = e @ problem.phi / z
        second[i : i + step] = (e @ pairs / z).reshape(-1, k, k)
    loss = float((run.sizes * logz).sum() - (run.w * run.sums).sum()) / problem.total
    grad = (run.sizes[:, None] * mean - run.sums) / problem.total
    hess = run.sizes[:, None, None] * (second - mean[:, :, None] * mean[:, None, :]) / problem.total
    return loss, grad, hess


def system(run: Run, problem: Problem, left: np.ndarray | None, right: np.ndarray | None):
    """(loss with the jumps inside the run, gradient, diagonal blocks); ``left`` and ``right`` are the neighbours' weights."""
    loss, grad, hess = terms(run, problem)
    link, n, k = problem.link, *run.w.shape
    jump = np.diff(run.w, axis=0)
    loss += problem.penalty * float((jump**2).sum()) / problem.joint
    grad[1:] += link * jump
    grad[:-1] -= link * jump
    degree = np.full(n, 2.0)
    if left is None:
        degree[0] -= 1
    else:
        grad[0] += link * (run.w[0] - left)
    if right is None:
        degree[-1] -= 1
    else:
        grad[-1] += link * (run.w[-1] - right)
    return loss, grad, hess + (link * degree[:, None, None] + 1e-12) * np.eye(k)


def eliminate(run: Run, problem: Problem, left: np.ndarray | None, right: np.ndarray | None) -> dict[str, np.ndarray]:
    """What the rest of the series needs of a run: its ends' weights and moves, its loss and slopes.

    Moves have 1 + 2 k columns: for the run's own gradient, and per unit move of the place before and after.
    """
    loss, grad, diagonal = system(run, problem, left, right)
    n, k = run.w.shape
    r = np.zeros((n, k, 1 + 2 * k))
    r[:, :, 0] = -grad
    if left is not None:
        r[0, :, 1 : 1 + k] = problem.link * np.eye(k)
    if right is not None:
        r[-1, :, 1 + k :] = problem.link * np.eye(k)
    x = solve_linked(diagonal, problem.link, r)
    return {"loss": np.array([loss]), "w": run.w[[0, -1]], "x": x[[0, -1]], "slope": np.einsum("nk,nkr->r", grad, x)}


def moved(run: Run, problem: Problem, left, right, left_move, right_move, scale: float) -> Run:
    """The run after ``scale`` times the Newton step, given the moves of the places next to it."""
    _, grad, diagonal = system(run, problem, left, right)
    r = -grad
    if left is not None:
        r[0] += problem.link * left_move
    if right is not None:
        r[-1] += problem.link * right_move
    return Run(run.sizes, run.sums, run.w + scale * solve_linked(diagonal, problem.link, r[:, :, None])[:, :, 0])


# --- the whole series ----------------------------------------------------------------------


def border_moves(parts: list[dict]) -> tuple[list, float]:
    """Moves of every run's first and last place (2 x k each), and the slope of the whole step."""
    k = parts[0]["w"].shape[1]
    n = len(parts)
    a, c, r = np.zeros((n, 2 * k, 2 * k)), np.zeros((n, 2 * k, 2 * k)), np.zeros((n, 2 * k, 1))
    for i, p in enumerate(parts):
        r[i] = p["x"][:, :, 0].reshape(2 * k, 1)
        if i:
            a[i][:, k:] = p["x"][:, :, 1 : 1 + k].reshape(2 * k, k)  # by the last place of the run before
        if i < n - 1:
            c[i][:, :k] = p["x"][:, :, 1 + k :].reshape(2 * k, k)  # by the first place of the run after
    x = solve_chain(a, np.broadcast_to(np.eye(2 * k), a.shape).copy(), c, r)[:, :, 0].reshape(n, 2, k)
    slope = 0.0
    for i, p in enumerate(parts):
        s = p["slope"]
        slope += s[0] + (s[1 : 1 + k] @ x[i - 1][1] if i else 0.0) + (s[1 + k :] @ x[i + 1][0] if i < n - 1 else 0.0)
    return x, float(slope)


def whole_loss(parts: list[dict], problem: Problem) -> float:
    jumps = sum(float(((b["w"][0] - a["w"][1]) ** 2).sum()) for a, b in zip(parts, parts[1:]))
    return sum(float(p["loss"][0]) for p in parts) + problem.penalty * jumps / problem.joint


class _Ends:
    """Weights of the places next to a run, from the first and last weights of all runs (n x 2 x k)."""

    def __init__(self, w: np.ndarray):
        self.w = w

    def __getitem__(self, i: int):
        return (self.w[i - 1][1] if i else None), (self.w[i + 1][0] if i < len(self.w) - 1 else None)


def _advanced(run: Run, i: int, problem: Problem, order: tuple) -> Run:
    ends, x, scale = order
    left, right = _Ends(ends)[i]
    left_move, right_move = _Ends(x)[i]
    return moved(run, problem, left, right, left_move, right_move, scale)


class HeldRuns:
    """All runs on the driver: {variant: [Run, ...]}."""

    def __init__(self, runs: dict[int, list[Run]], problems: dict[int, Problem]):
        self.runs, self.problems, self.tried = runs, problems, {}
        self.moving: set[int] = set()

    def step(self, orders: dict[int, tuple | None]) -> dict[int, list[dict]]:
        """Parts of each variant's runs after its order (None: as they are); kept once accepted."""
        out = {}
        for v, order in orders.items():
            runs, problem = self.runs[v], self.problems[v]
            if order is not None:
                runs = [_advanced(run, i, problem, order) for i, run in enumerate(runs)]
            self.tried[v] = runs
            ends = _Ends(np.array([run.w[[0, -1]] for run in runs]))
            out[v] = [eliminate(run, problem, *ends[i]) for i, run in enumerate(runs)]
        return out

    def accept(self, variants: list[int]) -> None:
        for v in variants:
            self.runs[v] = self.tried[v]

    def drop(self) -> None:
        """Nothing is written."""


ROW = "variant int, block int, sizes array<double>, sums array<double>, w array<double>, part array<double>"
NAMES = [column.split()[0] for column in ROW.split(", ")]


def numbers_of(column: pa.ListArray, i: int) -> np.ndarray:
    """The numbers of row ``i``, as a view of the column."""
    return column[i].values.to_numpy(zero_copy_only=False)


def run_row(variant: int, block: int, *numbers: np.ndarray) -> pa.RecordBatch:
    """A batch of one row of ROW; no number passes through a Python list."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.float64())) for x in numbers]
    return pa.RecordBatch.from_arrays([pa.array([variant], pa.int32()), pa.array([block], pa.int32()), *lists], NAMES)


class WrittenRuns:
    """Runs as rows of written tables, one row per variant and run; a step is one pass.

    The weights next to a run after a step are those of the border solution, so they are known
    before the pass. Tables that are no longer needed are deleted.
    """

    def __init__(self, rows: DataFrame, problems: dict[int, Problem]):
        self.rows, self.problems, self.tried = rows, problems, None
        self.moving: set[int] = set()

    def step(self, orders: dict[int, tuple | None]) -> dict[int, list[dict]]:
        spark = self.rows.sparkSession
        new_ends = {v: None if o is None else o[0] + o[2] * o[1] for v, o in orders.items()}
        shared = spark.sparkContext.broadcast((orders, new_ends, self.problems))

        def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            orders, new_ends, problems = shared.value
            for batch in batches:
                variants, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, (variant, block) in enumerate(zip(variants, blocks)):
                    if variant not in orders:
                        yield batch.slice(i, 1)
                        continue
                    sizes, sums, w = (numbers_of(batch.column(j), i) for j in (2, 3, 4))
                    problem = problems[variant]
                    k = problem.phi.shape[1]
                    run = Run(sizes, sums.reshape(-1, k), w.reshape(-1, k))
                    order = orders[variant]
                    if order is not None:
                        run = _advanced(run, block, problem, order)
                        left, right = _Ends(new_ends[variant])[block]
                    else:  # the start: all weights are zero
                        left = None if block == 0 else np.zeros(k)
                        right = None if block == -(-problem.places // BLOCK) - 1 else np.zeros(k)
                    p = eliminate(run, problem, left, right)
                    part = np.concatenate([p["loss"], p["w"].ravel(), p["x"].ravel(), p["slope"]])
                    yield run_row(variant, block, sizes, sums, run.w.ravel(), part)

        if self.tried is not None and self.tried is not self.rows:
            discard(self.tried)
        self.tried = materialise(self.rows.mapInArrow(run_rows, ROW), "series-runs")
        shared.unpersist()
        out: dict[int, list[dict]] = {v: [] for v in orders}
        # One row per run, with some 4 k^2 numbers.
        for r in self.tried.where(F.col("variant").isin(list(orders))).select("variant", "block", "part").orderBy("variant", "block").collect():
            k, part = self.problems[r["variant"]].phi.shape[1], np.array(r["part"])
            width = 2 * k * (1 + 2 * k)
            out[r["variant"]].append(
                {
                    "loss": part[:1],
                    "w": part[1 : 1 + 2 * k].reshape(2, k),
                    "x": part[1 + 2 * k : 1 + 2 * k + width].reshape(2, k, 1 + 2 * k),
                    "slope": part[1 + 2 * k + width :],
                }
            )
        return out

    def accept(self, variants: list[int]) -> None:
        """``variants`` are all that moved, or the rest keeps its earlier rows."""
        tried, before = self.tried, self.rows
        if set(variants) != {v for v in self.moving}:
            kept = F.col("variant").isin(variants)
            self.rows = materialise(tried.where(kept).unionByName(before.where(~kept)), "series-runs")
            discard(tried)
        else:
            self.rows = tried
        self.tried = None
        discard(before)

    def drop(self) -> None:
        """Delete what is written; the weights are gone."""
        for table in (self.rows, self.tried):
            if table is not None:
                discard(table)


def descend(runs: HeldRuns | WrittenRuns) -> dict[int, float]:
    """Newton's steps of all variants side by side; the losses where they end."""
    problems = runs.problems
    parts = runs.step({v: None for v in problems})
    runs.moving = set(problems)
    runs.accept(list(problems))
    loss = {v: whole_loss(parts[v], problems[v]) for v in problems}
    live = set(problems)
    for _ in range(100):
        steps = {v: border_moves(parts[v]) for v in live}
        live = {v for v in live if steps[v][1] < -TOLERANCE}
        scale, open_ = {v: 1.0 for v in live}, set(live)
        while open_:
            ends = {v: np.array([p["w"] for p in parts[v]]) for v in open_}
            tried = runs.step({v: (ends[v], steps[v][0], scale[v]) for v in open_})
            fine = {v for v in open_ if whole_loss(tried[v], problems[v]) <= loss[v] + 1e-4 * scale[v] * steps[v][1]}
            tired = {v for v in open_ - fine if scale[v] < 1e-6}
            runs.moving = set(open_)
            if fine:
                runs.accept(sorted(fine))
            for v in fine:
                parts[v], loss[v] = tried[v], whole_loss(tried[v], problems[v])
            live -= tired
            open_ -= fine | tired
            for v in open_:
                scale[v] *= 0.5
        if not live:
            break
    return loss


def _block_rows(k: int):
    """One row per run -> ROW with zero weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = (batch.column(j).to_pylist() for j in range(3))
            for i, (variant, block, count) in enumerate(zip(*names)):
                y, n, own = batch.column(3)[i].values.flatten()
                at = y.to_numpy(zero_copy_only=False) - block * BLOCK
                sizes, sums = np.zeros(count), np.zeros((count, k))
                sizes[at] = n.to_numpy(zero_copy_only=False)
                sums[at] = own.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                yield run_row(variant, block, sizes, sums.ravel(), np.zeros(count * k), np.zeros(0))

    return run


def series_path(table: DataFrame, k: int, penalty: float, places: int, held: int = HELD) -> tuple[HeldRuns | WrittenRuns, dict[int, float]]:
    """Weights of every place and the loss, by variant of a pattern table (variant, phi of 0/1, y = place, cnt).

    Places are 0 .. ``places - 1``; a place may have several texts or none.
    """
    problems = {}
    for variant, part in table.groupBy("variant", "phi").agg(F.sum("cnt").alias("cnt")).toPandas().groupby("variant"):  # at most 2^k patterns
        phi = np.array([list(p) for p in part["phi"]], dtype=float).reshape(len(part), k)
        counts = part["cnt"].to_numpy(float)
        problems[int(variant)] = Problem(phi, counts, float(counts.sum()), places, penalty)
    sums = F.array(*[F.sum(F.get("phi", F.lit(i)).cast("double") * F.col("cnt")) for i in range(k)])
    steps = table.groupBy("variant", "y").agg(F.sum("cnt").cast("double").alias("n"), sums.alias("sums"))
    if places * k * len(problems) <= held:
        got = steps.select(F.col("variant").cast("int").alias("variant"), F.col("y").cast("long").alias("y"), "n", "sums").toArrow().combine_chunks()
        which, y, n = (got[c].to_numpy() for c in ("variant", "y", "n"))
        own = pc.list_flatten(got["sums"]).to_numpy().reshape(-1, k)
        sizes = {v: np.zeros(places) for v in problems}
        totals = {v: np.zeros((places, k)) for v in problems}
        for v in problems:
            part = which == v
            sizes[v][y[part]] = n[part]
            totals[v][y[part]] = own[part]
        cuts = range(0, places, BLOCK)
        runs = {v: [Run(sizes[v][i : i + BLOCK], totals[v][i : i + BLOCK], np.zeros((min(BLOCK, places - i), k))) for i in cuts] for v in problems}
        source: HeldRuns | WrittenRuns = HeldRuns(runs, problems)
    else:
        block = F.floor(F.col("y") / BLOCK).cast("int")
        count = F.least(F.lit(BLOCK), F.lit(places) - F.col("block") * BLOCK).cast("int")
        own = steps.withColumn("block", block).groupBy("variant", "block").agg(F.collect_list(F.struct("y", "n", "sums")).alias("places"))
        every = own.sparkSession.range(-(-places // BLOCK)).select(F.explode(F.array(*[F.lit(v) for v in problems])).alias("variant"), F.col("id").cast("int").alias("block"))
        own = every.join(own, ["variant", "block"], "left").select(
            F.col("variant").cast("int").alias("variant"), "block", count.alias("count"), F.coalesce("places", F.array().cast(own.schema["places"].dataType)).alias("places")
        )
        # A number of tasks that is asked for is not merged into fewer, and batches of few runs keep a task small.
        spark = own.sparkSession
        bound_batches(spark)
        tasks = min(TASKS * spark.sparkContext.defaultParallelism, -(-places // BLOCK) * len(problems))
        own = own.repartition(tasks, "variant", "block")
        source = WrittenRuns(materialise(own.mapInArrow(_block_rows(k), ROW), "series-runs"), problems)
    return source, descend(source)


def path_weights(source: HeldRuns | WrittenRuns, spark, variant: int = 0) -> DataFrame:
    """(t, w): the weights of every place."""
    k = source.problems[variant].phi.shape[1]
    if isinstance(source, WrittenRuns):
        rows = source.rows.where(F.col("variant") == variant).select("block", "w")
        cut = F.expr(f"transform(sequence(0, cast(size(w) / {k} as int) - 1), i -> slice(w, i * {k} + 1, {k}))")
        placed = rows.select("block", F.posexplode(cut).alias("i", "w"))
        return placed.select((F.col("block").cast("long") * BLOCK + F.col("i")).alias("t"), "w")
    w = np.concatenate([run.w for run in source.runs[variant]])
    return spark.createDataFrame(pa.table({"t": pa.array(np.arange(len(w))), "w": pa.array(list(w), pa.list_(pa.float64()))}))
