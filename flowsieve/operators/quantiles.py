"""Quantiles of many columns at once, exact at any table size.

Two passes over the table serve all columns, probabilities and ranks. The first takes
one sketch per column, which gives its values at evenly spaced ranks, the pins. On large
tables the sketch is fed every so many-th value of sorted runs, which all rows are in: a
rank is off by half a step a run at most. The second counts the rows at and between the pins around each wanted rank and writes out
the few values strictly between them. A rank that falls on a pin is known by then; the
others are looked up among the written values, which are narrowed by further pins while
more of them are left than one task should rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.session import local_frame, stage

ACCURACY = 4_000
# Pins of a first sketch, and of each narrowing of what lies between two of them.
GRID, FINE_GRID = 1_000, 64
# Tables of at most so many rows are ranked on the driver.
HEAD_ROWS = 8_192
# Step within sorted runs, rows of a table for each unit of it, and values a task sorts at once.
STRIDE, STRIDE_ROWS, RUN_CELLS = 64, 1 << 14, 1 << 21
# Written values between two pins which one task may rank.
RANKED_ROWS = 50_000

Interval = tuple[int, int]  # column, code: 2k lies below pin k (above pin k - 1), 2k + 1 on it


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "exact", ranked_rows: int = RANKED_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of the non-null values of each column.

    ``exact`` reads the table twice; ``approx`` takes one sketch. A column without
    values has None for each probability.
    """
    if method == "approx":
        return _approximate(df, columns, probs)
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    order = OrderStatistics(df, columns, ranked_rows)
    order.find({c: [r for p in probs for r in ranks(p, order.filled[c])] for c in columns})
    return {c: [interpolated(p, order.filled[c], lambda r: order.value(c, r)) for p in probs] for c in columns}


def _approximate(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    if not columns:
        return {}
    points = list(map(float, probs))
    row = df.agg(*[F.percentile_approx(ref(c).cast("double"), points, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: list(v) if v is not None else [None] * len(points) for c, v in zip(columns, row)}


def ranks(p: float, rows: int) -> tuple[int, ...]:
    """The ranks (from 0) between which the quantile ``p`` of so many rows lies."""
    if not rows:
        return ()
    low = min(math.floor(p * (rows - 1)), rows - 1)
    return low, min(low + 1, rows - 1)


def interpolated(p: float, rows: int, value) -> float | None:
    """The quantile ``p`` from ``value``, which gives the value at a rank."""
    if not rows:
        return None
    low, high = ranks(p, rows)
    weight = p * (rows - 1) - low
    return value(low) if weight == 0 else value(low) + (value(high) - value(low)) * weight


class OrderStatistics:
    """Sketches of all columns, then the exact values at any ranks.

    ``rows`` counts the table, ``filled`` the non-null values of each column. ``find``
    looks up ranks (from 0, among the non-null values in ascending order), ``value``
    returns them.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], ranked_rows: int = RANKED_ROWS):
        self.columns, self.ranked_rows = list(columns), ranked_rows
        self.base = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(self.columns)])
        # The evenly spaced ranks as one text: hundreds of literals a column would swell the plan.
        even = "cast(split('" + ",".join(str(i / GRID) for i in range(GRID + 1)) + "', ',') as array<double>)"
        grid: dict[int, tuple[int, list[float]]] = {}
        head = self.base.limit(HEAD_ROWS + 1).collect() if self.columns else []
        if self.columns and len(head) <= HEAD_ROWS:
            # The whole of a small table: counted and ranked without a further pass.
            self.rows: int = len(head)
            grid = {i: _ranked_grid([r[i] for r in head]) for i in range(len(self.columns))}
        else:
            self.rows = self.base.count()
        stride = min(STRIDE, self.rows // STRIDE_ROWS)
        if stride > 1 and self.columns and not grid:
            runs = _thinned(self.base, stride).groupBy("col").agg(
                F.sum("n").alias("n"), F.count("value").alias("kept"), F.expr(f"percentile_approx(value, {even}, {ACCURACY})").alias("grid")
            )
            # Of short runs too much or too little is kept: such a column takes the whole sketch.
            grid = {r["col"]: (r["n"], r["grid"]) for r in runs.collect() if abs(r["kept"] * stride - r["n"]) * GRID <= r["n"]}
        if rest := [i for i in range(len(self.columns)) if i not in grid]:
            sketches = [F.expr(f"percentile_approx(c{i}, {even}, {ACCURACY})").alias(f"s{i}") for i in rest]
            row = self.base.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in rest], *sketches).first()
            grid |= {i: (row[f"n{i}"], row[f"s{i}"]) for i in rest}
        self.filled = {c: grid[i][0] for i, c in enumerate(self.columns)}
        self._grid = [grid[i][1] for i in range(len(self.columns))]
        self._found: dict[tuple[int, int], float] = {}

    def value(self, column: str, rank: int) -> float:
        return self._found[self.columns.index(column), rank]

    def find(self, wanted: Mapping[str, Iterable[int]]) -> None:
        """One pass over the table for all ranks of all columns."""
        todo = {(self.columns.index(c), r) for c, found in wanted.items() for r in found} - self._found.keys()
        pins = {c: self._pins(c, {r for k, r in todo if k == c}) for c in {c for c, _ in todo}}
        # Intervals on both sides of a pin next to a wanted rank are written out.
        written = {c: {2 * k for k in range(len(p) + 1)} - self._outer(c, p, {r for k, r in todo if k == c}) for c, p in pins.items()}
        while todo:
            between = stage(_split(self.base, pins, written), "between-pins")
            sums = between.where(F.col("value").isNull()).groupBy("col", "code").agg(F.sum("n").alias("n"))
            counts = {(r["col"], r["code"]): r["n"] for r in sums.collect()}  # a few rows per column
            inner: dict[Interval, set[int]] = {}
            for c, rank in todo:
                code, below = self._interval(c, rank, counts, 2 * len(pins[c]) + 1)
                if code % 2:
                    self._found[c, rank] = float(pins[c][code // 2])
                elif code in written[c]:
                    inner.setdefault((c, code), set()).add(rank - below)
            values = _ranked(between, inner, {i: counts[i] for i in inner}, self.ranked_rows)
            missed = set()
            for c, rank in todo:
                code, below = self._interval(c, rank, counts, 2 * len(pins[c]) + 1)
                if code % 2 == 0 and code in written[c]:
                    self._found[c, rank] = values[c, code, rank - below]
                elif code % 2 == 0:
                    missed.add((c, rank))
            # A sketch further off than its bound is mended by a pass that writes where the rank is.
            written = {c: {self._interval(c, r, counts, 2 * len(pins[c]) + 1)[0] for k, r in missed if k == c} for c in {c for c, _ in missed}}
            pins = {c: pins[c] for c in written}
            todo = missed

    def _around(self, c: int, rank: int) -> tuple[int, int]:
        """Places of the grid which hold the rank for sure."""
        rows = self.filled[self.columns[c]]
        low = math.floor((rank / rows - 1 / ACCURACY) * GRID) - 1
        high = math.ceil(((rank + 1) / rows + 1 / ACCURACY) * GRID) + 1
        return max(low, 0), min(high, GRID)

    def _pins(self, c: int, wanted: set[int]) -> np.ndarray:
        ends = [self._grid[c][place] for r in wanted for place in self._around(c, r)]
        return np.unique(np.array(ends, np.float64) + 0.0)  # -0.0 becomes 0.0

    def _outer(self, c: int, pins: np.ndarray, wanted: set[int]) -> set[int]:
        """Codes of the intervals that no wanted rank can be in."""
        inside: set[int] = set()
        for r in wanted:
            low, high = self._around(c, r)
            first = 0 if low == 0 else int(np.searchsorted(pins, self._grid[c][low])) + 1
            last = len(pins) if high == GRID else int(np.searchsorted(pins, self._grid[c][high]))
            inside.update(2 * k for k in range(first, last + 1))
        return {2 * k for k in range(len(pins) + 1)} - inside

    @staticmethod
    def _interval(c: int, rank: int, counts: dict[Interval, int], codes: int) -> tuple[int, int]:
        """The code whose rows hold the rank, and the number of rows below them."""
        below = 0
        for code in range(codes):
            n = counts.get((c, code), 0)
            if rank < below + n:
                return code, below
            below += n
        raise ValueError("a rank beyond the rows of its column")


def _ranked_grid(values: Sequence[float | None]) -> tuple[int, list[float] | None]:
    """The number of the values there are, and those at evenly spaced ranks, NaN last."""
    x = np.sort(np.array([v for v in values if v is not None], np.float64))
    if not len(x):
        return 0, None
    return len(x), x[np.clip(np.ceil(np.arange(GRID + 1) / GRID * len(x)).astype(int) - 1, 0, len(x) - 1)].tolist()


def _thinned(base: DataFrame, stride: int) -> DataFrame:
    """(col, code, value, n): every ``stride``-th value of sorted runs, and the non-null values counted (value null)."""
    columns = len(base.columns)
    most = max(ACCURACY, RUN_CELLS // columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(columns)]
        counts = np.zeros(columns, np.int64)

        def thin(c: int) -> pa.RecordBatch:
            kept = np.sort(np.concatenate(held[c]))[stride // 2 :: stride]
            held[c].clear()
            return _cells(np.full(len(kept), c), np.zeros(len(kept)), kept, np.zeros(len(kept)))

        for batch in batches:
            for c in range(columns):
                x = batch.column(c).drop_null().to_numpy() + 0.0
                counts[c] += len(x)
                held[c].append(x)
                if sum(map(len, held[c])) >= most:
                    yield thin(c)
        for c in range(columns):
            if held[c]:
                yield thin(c)
        yield _cells(np.arange(columns), np.zeros(columns), None, counts)

    return base.mapInArrow(run, "col int, code int, value double, n long")


def _split(base: DataFrame, pins: dict[int, np.ndarray], written: dict[int, set[int]]) -> DataFrame:
    """(col, code, value, n): counts of every code (value null), and the written values."""
    columns = sorted(pins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {c: np.zeros(2 * len(pins[c]) + 1, np.int64) for c in columns}
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i, c in enumerate(columns):
                x = batch.column(i).drop_null().to_numpy() + 0.0
                at = np.searchsorted(pins[c], x)
                on = pins[c][np.minimum(at, len(pins[c]) - 1)] == x
                code = 2 * at + (on | (np.isnan(x) & (at < len(pins[c]))))
                counts[c] += np.bincount(code, minlength=len(counts[c]))
                if written[c]:
                    kept = np.isin(code, list(written[c]))
                    values, n = np.unique(x[kept], return_counts=True)
                    at = np.searchsorted(pins[c], values)
                    out.append((np.full(len(values), c), 2 * at, values, n))
            if out:
                yield _cells(*map(np.concatenate, zip(*out)))
        rows = [(c, code, n) for c in columns for code, n in enumerate(counts[c]) if n]
        if rows:
            c, code, n = np.array(rows, np.int64).T
            yield _cells(c, code, None, n)

    return base.select(*[f"c{c}" for c in columns]).mapInArrow(run, "col int, code int, value double, n long")


def _cells(c: np.ndarray, code: np.ndarray, values: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    value = pa.nulls(len(c), pa.float64()) if values is None else pa.array(values, pa.float64(), from_pandas=False)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(code, pa.int32()), value, pa.array(n, pa.int64())], ["col", "code", "value", "n"])


def _ranked(between: DataFrame, inner: dict[Interval, set[int]], sizes: dict[Interval, int], most: int) -> dict[tuple[int, int, int], float]:
    """Values at ranks inside intervals, by (col, code, rank)."""
    if not inner:
        return {}
    spark = between.sparkSession
    asked = [(c, code, rank, rank) for (c, code), found in inner.items() for rank in found]
    # Numbers of the wanted ranks: a few per column.
    wanted = local_frame(spark, asked, "col int, code int, rank bigint, left bigint")
    cells = between.where(F.col("value").isNotNull()).join(F.broadcast(wanted), ["col", "code"])
    found: dict[tuple[int, int, int], float] = {}
    largest = max(sizes.values())
    while largest > most:
        cells = stage(cells, "cells")
        key = ["col", "code", "rank"]
        even = "cast(split('" + ",".join(str(i / FINE_GRID) for i in range(FINE_GRID + 1)) + "', ',') as array<double>)"
        pins = cells.groupBy(*key).agg(F.array_distinct(F.expr(f"percentile_approx(value, {even}, {ACCURACY})")).alias("pins"))
        pinned = cells.join(F.broadcast(pins), key)  # at most FINE_GRID + 1 pins a rank
        lower = F.size(F.filter("pins", lambda p: p < F.col("value")))
        part = stage(pinned.withColumn("part", 2 * lower + F.array_contains("pins", F.col("value")).cast("int")).withColumn("pin", F.element_at("pins", F.least(lower + 1, F.size("pins")))).drop("pins"), "parts")
        order = Window.partitionBy(*key).orderBy("part")
        sums = part.groupBy(*key, "part").agg(F.sum("n").alias("rows"), F.min("pin").alias("pin"), F.min("left").alias("left")).withColumn("upto", F.sum("rows").over(order))
        held = sums.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("rows") <= F.col("left"))).collect()  # a row per wanted rank
        found |= {(r["col"], r["code"], r["rank"]): r["pin"] for r in held if r["part"] % 2}
        rest = [r for r in held if r["part"] % 2 == 0]
        if not rest:
            return found
        largest = max(r["rows"] for r in rest)
        kept = local_frame(spark, [(r["col"], r["code"], r["rank"], r["part"], r["left"] - r["upto"] + r["rows"]) for r in rest], "col int, code int, rank bigint, part int, left bigint")
        cells = part.drop("left", "pin").join(F.broadcast(kept), [*key, "part"]).drop("part")
    running = Window.partitionBy("col", "code", "rank").orderBy("value")
    rows = (
        cells.groupBy("col", "code", "rank", "value").agg(F.sum("n").alias("n"), F.min("left").alias("left"))
        .withColumn("upto", F.sum("n").over(running))
        .where(F.col("upto") > F.col("left"))
        .groupBy("col", "code", "rank").agg(F.min("value").alias("value"))
        .collect()
    )
    return found | {(r["col"], r["code"], r["rank"]): r["value"] for r in rows}
