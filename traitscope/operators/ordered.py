"""Ordered operators without a global window: numbering, prefix sums, smoothing, ranks.

One way serves all: range-partition by the order, sort inside the partitions, scan each
partition in Arrow batches with a local state that starts at zero, and write the result
(which also pins the sampled range borders). A summary with one row per block (at most the
number of partitions) then gives each block the state it should have started with.
Order keys must end in a unique column, so that equal values spread over many blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import CLEANUP, discard, materialise

# Rows of a band that are shuffled at once, and of its largest blocks; lines of a run that are kept as they are.
SHUFFLED, LARGEST, HULL = 1 << 25, 1 << 20, 512


def blocks_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_scan(
    df: DataFrame,
    order: Sequence[str],
    added: T.StructType,
    make_step: Callable[[], Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]] | None = None,
    inputs: Sequence[str] = (),
    blocks: int | None = None,
    label: str = "ordered",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with ``_block``, ``_pos`` (0-based in its block) and the columns of ``added``.

    ``make_step`` returns a function that is called once per Arrow batch of a block, in
    order, with the ``inputs`` as numpy arrays; it keeps its own running state. With ``keep``
    only those columns stay after the sort.
    """
    n = blocks or blocks_for(df)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # monotonically_increasing_id is (partition << 33) + row within the partition.
    marked = ranged.withColumn("_mid", F.monotonically_increasing_id())
    marked = marked.withColumn("_block", F.shiftright("_mid", 33).cast("int"))
    marked = marked.withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")
    if keep is not None:
        marked = marked.select(*keep, "_block", "_pos")
    if make_step is not None:
        schema = T.StructType(marked.schema.fields + added.fields)
        inputs = list(inputs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = make_step()
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                out = step({c: column_array(batch.column(batch.schema.get_field_index(c))) for c in inputs})
                arrays = list(batch.columns)
                names = list(batch.schema.names)
                for field in added.fields:
                    arrays.append(to_arrow(out[field.name]))
                    names.append(field.name)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        marked = marked.mapInArrow(run, schema)
    return materialise(marked, label)


def column_array(column: pa.Array) -> np.ndarray:
    """Numbers as a vector, arrays of equal length as a matrix."""
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def to_arrow(values: np.ndarray) -> pa.Array:
    if values.ndim == 1:
        return pa.array(values)
    width = values.shape[1]
    offsets = np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def small_table(spark: SparkSession, frame: pd.DataFrame, schema: str) -> DataFrame:
    """A driver table with at most one row per block."""
    return spark.createDataFrame(frame, schema)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "t") -> tuple[DataFrame, int]:
    """0-based position in the global order, and the number of rows."""
    scanned = sorted_scan(df, order, T.StructType([]), label="numbered")
    sizes = scanned.groupBy("_block").agg(F.count("*").alias("size")).toPandas().sort_values("_block")
    total = int(sizes["size"].sum())
    sizes["before"] = sizes["size"].cumsum() - sizes["size"]
    starts = small_table(df.sparkSession, sizes[["_block", "before"]], "_block int, before bigint")
    # One row per block: a bounded table.
    placed = scanned.join(F.broadcast(starts), "_block").withColumn(name, F.col("before") + F.col("_pos"))
    return placed.drop("_block", "_pos", "before"), total


def time_percentile(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``percentile`` in [0, 1]: position / (rows - 1)."""
    placed, total = number_rows(df, order)
    return placed.withColumn("percentile", F.col("t") / F.lit(float(max(total - 1, 1))))


def smoothing_step(rate: float) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """Exponential smoothing of a block from state 0, restarted where ``_rep`` changes.

    Chunks use the closed form of the recursion as one cumulative sum. They are at most 512
    rows long, and so short that the weights inside a chunk stay above 1e-8; at a rate of 1
    the curve is the series.
    """
    if not 0 <= rate <= 1:
        raise ValueError("the rate of smoothing is between 0 and 1")
    state = {"rep": None, "carry": None, "run": 0}
    keep = 1.0 - rate
    size = 512 if keep == 1 else 1 if keep < 1e-8 else int(np.clip(np.log(1e-8) / np.log(keep), 1, 512))
    decay = keep ** np.arange(1, size + 1)
    gain = rate / decay if keep else np.zeros(size)

    def one(x: np.ndarray, carry: np.ndarray) -> np.ndarray:
        if not keep:
            return x.copy()
        out = np.empty_like(x)
        for a in range(0, len(x), size):
            part = x[a : a + size]
            d, g = decay[: len(part), None], gain[: len(part), None]
            out[a : a + size] = d * (carry + np.cumsum(part * g, axis=0))
            carry = out[a + len(part) - 1]
        return out

    def step(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = np.asarray(cols["_x"], dtype=float)
        reps = cols["_rep"]
        local, run = np.empty_like(x), np.empty(len(x), dtype=np.int64)
        edges = np.flatnonzero(np.diff(reps)) + 1
        for a, b in zip([0, *edges], [*edges, len(x)]):
            if state["rep"] != reps[a]:
                state.update(rep=reps[a], carry=np.zeros(x.shape[1]), run=0)
            local[a:b] = one(x[a:b], state["carry"])
            run[a:b] = state["run"] + np.arange(b - a)
            state.update(carry=local[b - 1], run=state["run"] + (b - a))
        return {"local": local, "_run": run}

    return step


def ema_curve(
    series: DataFrame,
    order: Sequence[str],
    values: str = "x",
    rate: float = 0.005,
    seed_n: int = 50,
    rep: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Exponentially smoothed curves: ``series`` with 0-based ``t`` and array ``curve``.

    ``values`` is an array column, one entry per curve. c_0 is the mean of the first
    ``seed_n`` values, c_i = (1 - rate) c_{i-1} + rate x_i. With ``rep`` there is one series
    per value of that integer column, by which ``order`` must sort first; all are smoothed in
    the same pass. ``keep`` names the columns of ``series`` to carry along (all by default).
    """
    rep_col = F.col(rep) if rep else F.lit(0)
    ready = series.withColumn("_rep", rep_col.cast("int")).withColumn("_x", F.col(values).cast("array<double>"))
    carried = [c for c in (series.columns if keep is None else keep) if c != "curve"]
    added = T.StructType([T.StructField("local", T.ArrayType(T.DoubleType())), T.StructField("_run", T.LongType())])
    scanned = sorted_scan(
        ready, order, added, lambda: smoothing_step(rate), ["_x", "_rep"], label="smoothed", keep=[*carried, "_rep", "_x"]
    )
    # One row per (block, series): how long the run is and where it ends.
    ends = (
        scanned.groupBy("_block", "_rep")
        .agg(F.max("_run").alias("last"), F.max_by("local", "_run").alias("end"))
        .toPandas()
        .sort_values(["_rep", "_block"])
    )
    # Position of each run in its series, to find the first seed_n rows.
    ends["size"] = ends["last"] + 1
    ends["before"] = ends.groupby("_rep")["size"].cumsum() - ends["size"]
    spark = series.sparkSession
    places = small_table(spark, ends[["_block", "_rep", "before"]], "_block int, _rep int, before bigint")
    placed = scanned.join(F.broadcast(places), ["_block", "_rep"]).withColumn("t", F.col("before") + F.col("_run"))
    head = (
        placed.filter(F.col("t") < seed_n)
        .select("_rep", "t", "_x")
        .toPandas()
        .sort_values(["_rep", "t"])
    )
    keep = 1.0 - rate
    starts = []
    for rep_id, runs in ends.groupby("_rep", sort=True):
        first = np.stack([np.asarray(v, dtype=float) for v in head[head["_rep"] == rep_id]["_x"]])
        # What row 0 lacks to be the seed fades from row 0 on; a later block begins with the state before it.
        state, ahead = first.mean(axis=0) - rate * first[0], 0
        for block, last, end, before in runs[["_block", "last", "end", "before"]].itertuples(index=False):
            starts.append((int(block), int(rep_id), int(before), ahead, [float(v) for v in state]))
            state, ahead = np.asarray(end, dtype=float) + keep ** (last + ahead) * state, 1
    begun = spark.createDataFrame(starts, "_block int, _rep int, before bigint, ahead int, start array<double>")
    fade = F.pow(F.lit(keep), (F.col("_run") + F.col("ahead")).cast("double"))
    curve = F.zip_with("local", "start", lambda a, s: a + fade * s)
    out = (
        scanned.join(F.broadcast(begun), ["_block", "_rep"])
        .withColumn("t", F.col("before") + F.col("_run"))
        .withColumn("curve", curve)
    )
    return out.select(*carried, "t", "curve")


def least_lines(at: np.ndarray, value: np.ndarray, fade: np.ndarray, bound: float) -> np.ndarray:
    """Indices that can be the least ``value + s * fade`` for a number s of at most ``bound``.

    These are lines over s: one that another undercuts at both ends of the range is never the least. Of many that are left
    those on the lower hull are. ``at`` falls in ``fade``.
    """
    low, high = value - bound * fade, value + bound * fade
    i, j = np.argmin(low), np.argmin(high)
    kept = np.flatnonzero((low < low[j]) & (high < high[i]))
    kept = np.unique(np.concatenate([kept, [i, j]]))
    order = kept[np.lexsort((high[kept], low[kept]))]
    ahead = np.minimum.accumulate(high[order])
    kept = np.sort(order[np.concatenate([[True], high[order][1:] < ahead[:-1]])])
    if len(kept) > HULL:
        hull: list[int] = []
        for c in kept[np.argsort(at[kept])]:
            while len(hull) > 1:
                o, m = hull[-2], hull[-1]
                if (fade[m] - fade[o]) * (value[c] - value[o]) < (value[m] - value[o]) * (fade[c] - fade[o]):
                    break
                hull.pop()
            if hull and fade[hull[-1]] == fade[c]:
                if value[hull[-1]] <= value[c]:
                    continue
                hull.pop()
            hull.append(c)
        kept = np.array(hull)
    return kept


class RunSummary:
    """What the band needs of a run of rows of one shuffle: its size, its end, its first values, and the rows
    that can be the least or the most of a curve, whatever the state before the run."""

    def __init__(self, width: int, keep: float, seed_n: int, bound: float):
        self.keep, self.seed_n, self.bound = keep, seed_n, bound
        self.size, self.end, self.head = 0, None, np.zeros((0, width))
        # Per curve and side (least, most of which the negative is the least): row numbers and values.
        self.lines = [[(np.zeros(0, np.int64), np.zeros(0)) for _ in range(2)] for _ in range(width)]

    def add(self, x: np.ndarray, local: np.ndarray) -> None:
        if len(self.head) < self.seed_n:
            self.head = np.concatenate([self.head, x[: self.seed_n - len(self.head)]])
        run = np.arange(self.size, self.size + len(x))
        for c, sides in enumerate(self.lines):
            for side, sign in enumerate((1.0, -1.0)):
                old_at, old = sides[side]
                value = sign * local[:, c]
                if self.keep**self.size * self.bound < 1e-30 and np.isfinite(value).all():
                    best = np.argmin(value)
                    new_at, new = run[best : best + 1], value[best : best + 1]
                else:
                    new_at, new = run, value
                at, value = np.concatenate([old_at, new_at]), np.concatenate([old, new])
                odd = np.flatnonzero(~np.isfinite(value))
                _, first = np.unique(value[odd], return_index=True)
                fine = np.flatnonzero(np.isfinite(value))
                if len(fine):
                    fine = fine[least_lines(at[fine], value[fine], self.keep ** at[fine].astype(float), self.bound)]
                kept = np.concatenate([fine, odd[first]])
                sides[side] = (at[kept], value[kept])
        self.size += len(x)
        self.end = local[-1].copy()


def run_summaries(rate: float, seed_n: int, bound: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (block, rep, x) in order -> (block, rep, summary), a row per run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, block, found = smoothing_step(rate), None, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block, reps, x = batch.column(0)[0].as_py(), column_array(batch.column(1)), np.asarray(column_array(batch.column(2)), dtype=float)
            local = step({"_x": x, "_rep": reps})["local"]
            edges = np.flatnonzero(np.diff(reps)) + 1
            for a, b in zip([0, *edges], [*edges, len(x)]):
                summary = found.setdefault(int(reps[a]), RunSummary(x.shape[1], 1.0 - rate, seed_n, bound))
                summary.add(x[a:b], local[a:b])
        for rep, s in found.items():
            told = pickle.dumps((s.size, s.end, s.head, s.lines))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rep], pa.int32()), pa.array([told], pa.binary())], names=["block", "rep", "told"])

    return run


def curve_range(runs: list[tuple], rate: float, seed_n: int) -> list[tuple[list, list]]:
    """Per curve the least and most values of the runs (see ``RunSummary``) of a shuffle, in order; NaN is more than any number."""
    keep = 1.0 - rate
    head = np.concatenate([r[2] for r in runs])[:seed_n]
    state, ahead = head.mean(axis=0) - rate * head[0], 0
    out: list[tuple[list, list]] = [([], []) for _ in state]
    for size, end, _, lines in runs:
        for c, sides in enumerate(lines):
            for side, (at, value) in enumerate(sides):
                values = (-value if side else value) + keep ** (at + ahead).astype(float) * state[c]
                out[c][side].extend(values)
        state, ahead = end + keep ** (size - 1 + ahead) * state, 1
    return out


def permutation_band(
    series: DataFrame, t: str = "t", values: str = "curve", rate: float = 0.005, seed_n: int = 100, reps: int = 100, seed: int = 0
) -> DataFrame:
    """(curve_id, lower, upper): range of the smoothed curves of ``reps`` shuffles of a series.

    The shuffles are rows of one table ordered by (rep, hash), smoothed in one pass, for as many
    repetitions at a time as keep the table at ``SHUFFLED`` rows: its shuffle files go before the next.
    Hashes are even, so the rows are dealt to their blocks without a sample. No smoothed row is
    written: a block keeps the few rows that can bound its curve (see ``RunSummary``). As in a plot of
    frequencies the band starts as [1, 0] and can only widen.
    """
    spark = series.sparkSession
    narrow = series.select(F.col(t).alias("_t0"), F.col(values).cast("array<double>").alias("_x"))
    size = lambda x: F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 0.0).otherwise(F.abs(x))
    top = F.max(F.aggregate("_x", F.lit(0.0), lambda a, x: F.greatest(a, size(x))))
    n, most = narrow.agg(F.count("*"), top).first()
    blocks, at_once = blocks_for(series), int(np.clip(SHUFFLED // max(n, 1), 1, min(reps, 256)))
    found: dict[int, tuple[list, list]] = {}
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for first in range(0, reps if n else 0, at_once):
            count = min(at_once, reps - first)
            parts = max(blocks, -(-n * count // LARGEST))
            shuffled = narrow.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
            shuffled = shuffled.withColumn("digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_t0").cast("string"))))
            share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
            place = F.floor((F.col("rep") - first + share) * F.lit(parts / count)).cast("int")
            # One binary sort key, the repetition before the hash: its first bytes decide the sort.
            key = F.unhex(F.concat(F.lpad(F.hex(F.col("rep") - first), 2, "0"), "digest")) if count > 1 else F.unhex("digest")
            dealt = shuffled.select("rep", "_t0", "_x", key.alias("key"), F.least(place, F.lit(parts - 1)).alias("place"))
            ready = dealt.repartitionById(parts, "place").sortWithinPartitions("key", "_t0").select("place", "rep", "_x")
            told = materialise(ready.mapInArrow(run_summaries(rate, seed_n, 2.0 * most), "block int, rep int, told binary"), "band")
            runs: dict[int, list[tuple]] = {}
            for r in told.orderBy("rep", "block").collect():  # one row per block and repetition
                runs.setdefault(r["rep"], []).append(pickle.loads(r["told"]))
            discard(told)
            for own in runs.values():
                for c, sides in enumerate(curve_range(own, rate, seed_n)):
                    for all_, now in zip(found.setdefault(c, ([], [])), sides):
                        all_.extend(now)
            for low, high in found.values():
                low[:] = [np.nanmin(low)] if not np.isnan(low).all() else [np.nan]
                high[:] = [np.max(high)]
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    rows = [(c, 1.0 if np.isnan(low[0]) else min(1.0, float(low[0])), float(np.maximum(0.0, high[0]))) for c, (low, high) in found.items()]
    return spark.createDataFrame(rows, "curve_id int, lower double, upper double")


def cumulative_step(inputs: Sequence[str]) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    carry = dict.fromkeys(inputs, 0)

    def step(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for c in inputs:
            sums = np.cumsum(cols[c].astype(np.int64)) + carry[c]
            carry[c] = int(sums[-1])
            out[f"cum_{c}"] = sums
        return out

    return step


def prefix_sums(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` of whole-number columns in the given order."""
    columns = list(columns)
    added = T.StructType([T.StructField(f"cum_{c}", T.LongType()) for c in columns])
    scanned = sorted_scan(df, order, added, lambda: cumulative_step(columns), columns, label="prefix")
    sums = scanned.groupBy("_block").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("_block")
    for c in columns:
        sums[c] = sums[c].cumsum() - sums[c]
    schema = "_block int, " + ", ".join(f"off_{c} bigint" for c in columns)
    offsets = small_table(df.sparkSession, sums.rename(columns={c: f"off_{c}" for c in columns}), schema)
    out = scanned.join(F.broadcast(offsets), "_block")
    for c in columns:
        out = out.withColumn(f"cum_{c}", F.col(f"cum_{c}") + F.col(f"off_{c}"))
    return out.drop("_block", "_pos", *[f"off_{c}" for c in columns])


def weight_jumps(weights: DataFrame) -> DataFrame:
    """Mean over steps and predicates of the squared change of (t, k, w), ``t`` a position.

    Neighbours meet in an equi-join on (k, t), so a long series is not one window group.
    """
    after = weights.select("k", (F.col("t") - 1).alias("t"), F.col("w").alias("w_next"))
    jump = F.col("w_next") - F.col("w")
    return weights.join(after, ["k", "t"]).agg(F.avg(jump * jump).alias("mean_squared_jump"))


def exact_percentiles(scores: DataFrame, column: str, points: Sequence[float]) -> list[float]:
    """Percentiles with linear interpolation, from running counts of the distinct values."""
    counts = scores.groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    running = prefix_sums(counts, ["v"], ["c"])
    n = int(running.agg(F.max("cum_c")).first()[0])
    wanted = {}
    for p in points:
        at = p / 100.0 * (n - 1)
        wanted[p] = (int(np.floor(at)), int(np.ceil(at)), at - np.floor(at))
    ranks = sorted({r for lo, hi, _ in wanted.values() for r in (lo, hi)})
    rank = F.explode(F.array(*[F.lit(r).cast("bigint") for r in ranks])).alias("r")
    held = running.select("v", "c", "cum_c", rank).filter((F.col("r") < F.col("cum_c")) & (F.col("r") >= F.col("cum_c") - F.col("c")))
    value = {row["r"]: row["v"] for row in held.select("r", "v").collect()}
    return [value[lo] + (value[hi] - value[lo]) * f for lo, hi, f in (wanted[p] for p in points)]
