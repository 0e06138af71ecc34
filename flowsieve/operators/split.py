"""Stratified hold-out splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.operators.selection import STRATUM, mark_first
from flowsieve.session import Pinned

TRAIN, TEST = "train", "test"


def test_quotas(sizes: DataFrame, test_fraction: float) -> DataFrame:
    """Test rows of each stratum (stratum, n, want).

    ``ceil(fraction * n)`` rows are held out in total. The training rows are
    shared out by size: the floor of each share, then one more for the largest
    remainders, ties by stratum name. What is left of a stratum is its test part.
    """
    over_all = Window.partitionBy()
    held_out = F.ceil(F.lit(float(test_fraction)) * F.col("total"))
    share = F.col("n") / F.col("total").cast("double") * F.col("train_total")
    by_remainder = Window.orderBy(F.desc("remainder"), STRATUM)
    return (
        sizes.withColumn("total", F.sum("n").over(over_all))
        .withColumn("train_total", F.col("total") - held_out)
        .withColumn("share", share)
        .withColumn("base", F.floor("share"))
        .withColumn("remainder", F.col("share") - F.col("base"))
        .withColumn("missing", F.col("train_total") - F.sum("base").over(over_all))
        .withColumn("place", F.row_number().over(by_remainder))
        .withColumn("extra", (F.col("place") <= F.col("missing")).cast("bigint"))
        .select(STRATUM, "n", (F.col("n") - F.col("base") - F.col("extra")).alias("want"))
    )


def stratified_split(
    df: DataFrame,
    stratum: str | Column,
    key: Sequence[str] | None = None,
    test_fraction: float = 0.2,
    seed: int = 42,
    out: str = "split",
    copies: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Add ``out`` = ``train`` or ``test`` with exact quotas in every stratum.

    For ``key``, ``copies`` and ``order`` see ``mark_first``.
    """
    column = ref(stratum) if isinstance(stratum, str) else stratum

    def quota(sizes: DataFrame) -> DataFrame:
        pinned = Pinned(sizes)
        small = [r for r in pinned.rows if r["n"] < 2] if pinned.small else pinned.frame.filter("n < 2").limit(5).collect()
        if small:
            raise ValueError(f"a stratum needs two rows to be split: {[r[0] for r in small[:5]]}")
        return test_quotas(pinned.frame, test_fraction)

    marked = mark_first(df, column, quota, key, seed, "_held_out", copies, order)
    name = F.when(F.col("_held_out"), F.lit(TEST)).otherwise(F.lit(TRAIN))
    return marked.withColumn(out, name).drop("_held_out")
