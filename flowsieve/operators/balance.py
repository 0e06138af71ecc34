"""Class rebalancing: down-sampling, rare classes, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.operators.classes import class_counts, majority_class
from flowsieve.operators.selection import take_n
from flowsieve.session import Pinned

# Fixed values of the training set-up.
BASE_ROWS = 100_000
MIN_CLASS_ROWS = 6


def downsample(
    df: DataFrame,
    label: str,
    n: int = BASE_ROWS,
    key: Sequence[str] | None = None,
    seed: int = 42,
    name: str | None = None,
) -> DataFrame:
    """Reduce one class to exactly ``min(n, size)`` rows; all other rows stay.

    The class is the named one, or the largest.
    """
    if name is None:
        largest = majority_class(df, label).first()
        if largest is None:
            return df
        name = largest[0]
    return take_n(df, n, key, seed, where=ref(label).eqNullSafe(F.lit(name)))


def rare_classes(df: DataFrame, label: str, minimum: int = MIN_CLASS_ROWS) -> DataFrame:
    """Classes with fewer than ``minimum`` rows, with their sizes."""
    return class_counts(df, label).filter(F.col("n") < minimum)


def drop_rare(df: DataFrame, label: str, minimum: int = MIN_CLASS_ROWS) -> DataFrame:
    rare = Pinned(rare_classes(df, label, minimum).select(ref(label).alias("_rare"))).side
    return df.join(rare, ref(label).eqNullSafe(F.col("_rare")), "left_anti")


def balanced_weights(df: DataFrame, label: str | Column, out: str = "weight") -> DataFrame:
    """Add ``n / (classes * class size)``; the weights of a table sum to its rows."""
    column = ref(label) if isinstance(label, str) else label
    sizes = Pinned(df.groupBy(column.alias("_class")).agg(F.count(F.lit(1)).alias("_size")))
    totals = sizes.frame.agg(F.sum("_size"), F.count(F.lit(1))).first()
    share = F.lit(float(totals[0] or 0)) / (F.lit(float(totals[1] or 1)) * F.col("_size"))
    side = sizes.side.select("_class", share.alias(out))
    return df.join(side, column.eqNullSafe(F.col("_class"))).drop("_class")
