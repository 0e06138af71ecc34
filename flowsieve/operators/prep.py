"""Feature fitting on training rows: one-hot, median imputation, robust scaling."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import numeric_columns, ref
from flowsieve.operators.quantiles import OrderStatistics, interpolated, quantiles, ranks
from flowsieve.session import local_frame

QUARTILES = (0.25, 0.5, 0.75)
# A spread below this counts as constant and is divided by one.
NO_SPREAD = 10 * sys.float_info.epsilon
NULL_NAME = "nan"


def any_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column, whether it holds a NULL."""
    return df.agg(*[F.coalesce(F.bool_or(ref(c).isNull()), F.lit(False)).alias(c) for c in columns])


@dataclass(frozen=True)
class OneHot:
    """Categories of the training rows in sorted order, NULL last; the first is dropped."""

    categories: dict[str, list[str | None]]
    # Training rows of each category, where it was fitted here.
    counts: dict[str, list[int]] = field(default_factory=dict, compare=False)

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> OneHot:
        """One pass finds the distinct values of all columns."""
        present = [c for c in columns if c in train.columns]
        if not present:
            return cls({})
        cells = F.array(
            *[F.struct(F.lit(c).alias("name"), ref(c).cast("string").alias("value")) for c in present]
        )
        distinct = train.select(F.explode(cells).alias("cell")).groupBy("cell.name", "cell.value")
        # Every category becomes a column, so the driver holds their names in any case.
        rows = distinct.agg(F.count(F.lit(1)).alias("n")).collect()
        found: dict[str, list[str | None]] = {}
        counts: dict[str, list[int]] = {}
        for c in present:
            seen = {r["value"]: r["n"] for r in rows if r["name"] == c}
            found[c] = sorted(v for v in seen if v is not None) + [None] * (None in seen)
            counts[c] = [seen[v] for v in found[c]]
        return cls(found, counts)

    def flags(self) -> dict[str, tuple[int, int]]:
        """Training rows of each 0/1 column: how many are 1, and all."""
        return {
            name: (ones, sum(counts))
            for (c, counts) in self.counts.items()
            for name, ones in zip(self._names(c), counts[1:])
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per category, in order; a table without rows for no columns."""
        rows = [(c, i, v) for c, values in self.categories.items() for i, v in enumerate(values)]
        frame = local_frame(spark, rows, "feature string, position int, category string")
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneHot:
        found: dict[str, list[str | None]] = {}
        for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r["feature"], r["position"])):
            found.setdefault(r["feature"], []).append(r["category"])
        return cls(found)

    def _names(self, c: str) -> list[str]:
        return [f"{c}_{NULL_NAME if v is None else v}" for v in self.categories[c][1:]]

    def names(self) -> list[str]:
        return [name for c in self.categories for name in self._names(c)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the columns by 0/1 columns; an unknown category is all zeros."""
        flags = [
            F.when(ref(c).eqNullSafe(F.lit(v)), F.lit(1.0)).otherwise(F.lit(0.0))
            for c, values in self.categories.items()
            for v in values[1:]
        ]
        kept = [ref(c) for c in df.columns if c not in self.categories]
        return df.select(*kept, *[f.alias(n) for f, n in zip(flags, self.names())])


def _after_filling(order: OrderStatistics, c: str, rank: int, median: float) -> float:
    filled, gaps = order.filled[c], order.rows - order.filled[c]
    if rank < filled and order.value(c, rank) < median:
        return order.value(c, rank)
    if rank >= gaps and order.value(c, rank - gaps) > median:
        return order.value(c, rank - gaps)
    return median


@dataclass(frozen=True)
class FeaturePrep:
    """Fitted medians, centres and spreads. Fit on training rows, apply to any rows."""

    median: dict[str, float]
    center: dict[str, float]
    spread: dict[str, float]
    empty: list[str] = field(default_factory=list)

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        columns: Sequence[str] | None = None,
        method: str = "exact",
        flags: Mapping[str, tuple[int, int]] | None = None,
    ) -> FeaturePrep:
        """Quartiles of all columns, before and after imputation, from two passes.

        ``flags`` names 0/1 columns whose counts are known (``OneHot.flags``): their
        quartiles take no pass. ``approx`` takes sketches. A column without a single
        value in training has no median: it is listed in ``empty`` and left out by
        ``transform``.
        """
        columns = list(columns if columns is not None else numeric_columns(train))
        known = {c: flags[c] for c in columns if c in (flags or {})}
        measured = [c for c in columns if c not in known]
        if method == "approx":
            median, quarters, empty = cls._approximate(train, measured)
        else:
            median, quarters, empty = cls._exact(train, measured)
        for c, (ones, rows) in known.items():
            quarters[c] = [interpolated(p, rows, lambda r: float(r >= rows - ones)) for p in QUARTILES]
            median[c] = quarters[c][1]
        median = {c: median[c] for c in columns if c in median}
        spread = {c: quarters[c][2] - quarters[c][0] for c in median}
        return cls(
            median,
            {c: quarters[c][1] for c in median},
            {c: s if s >= NO_SPREAD else 1.0 for c, s in spread.items()},
            empty,
        )

    @staticmethod
    def _exact(train: DataFrame, columns: list[str]) -> tuple[dict, dict, list[str]]:
        """Medians of the values there are, quartiles once the gaps are filled with them.

        Filling in the median moves ranks but makes no new value: at a rank of the
        filled column stands the value of that rank while it is below the median, the
        value of that rank less the gaps where it is above, and the median between.
        """
        if not columns:
            return {}, {}, []
        order = OrderStatistics(train, columns)
        rows, filled = order.rows, order.filled
        present = [c for c in columns if filled[c]]
        wanted = {}
        for c in present:
            after = [r for p in QUARTILES for r in ranks(p, rows)]
            moved = [r - (rows - filled[c]) for r in after]
            wanted[c] = {r for r in (*after, *moved, *ranks(0.5, filled[c])) if 0 <= r < filled[c]}
        order.find(wanted)
        median, quarters = {}, {}
        for c in present:
            median[c] = interpolated(0.5, filled[c], lambda r: order.value(c, r))
            quarters[c] = [interpolated(p, rows, lambda r: _after_filling(order, c, r, median[c])) for p in QUARTILES]
        return median, quarters, [c for c in columns if not filled[c]]

    @staticmethod
    def _approximate(train: DataFrame, columns: list[str]) -> tuple[dict, dict, list[str]]:
        first = quantiles(train, columns, [0.5], "approx")
        median = {c: v[0] for c, v in first.items() if v[0] is not None}
        imputed = train.select(*[F.coalesce(ref(c).cast("double"), F.lit(m)).alias(c) for c, m in median.items()])
        return median, quantiles(imputed, list(median), QUARTILES, "approx"), [c for c in columns if c not in median]

    @property
    def features(self) -> list[str]:
        return list(self.median)

    def impute(self, df: DataFrame) -> DataFrame:
        return self._project(df, scale=False)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._project(df, scale=True)

    def _project(self, df: DataFrame, scale: bool) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.empty:
                continue
            if c not in self.median:
                out.append(ref(c))
                continue
            value = F.coalesce(ref(c).cast("double"), F.lit(self.median[c]))
            if scale:
                value = (value - F.lit(self.center[c])) / F.lit(self.spread[c])
            out.append(value.alias(c))
        return df.select(*out)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, c, self.median[c], self.center[c], self.spread[c])
            for i, c in enumerate(self.median)
        ] + [(-1, c, None, None, None) for c in self.empty]
        schema = "position int, feature string, median double, center double, spread double"
        return local_frame(spark, rows, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePrep:
        rows = spark.read.parquet(path).orderBy("position").collect()
        fitted = [r for r in rows if r["position"] >= 0]
        return cls(
            {r["feature"]: r["median"] for r in fitted},
            {r["feature"]: r["center"] for r in fitted},
            {r["feature"]: r["spread"] for r in fitted},
            [r["feature"] for r in rows if r["position"] < 0],
        )
