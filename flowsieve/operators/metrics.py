"""Classification metrics as frames. All but average precision come from the counts
of (actual, predicted), at most classes squared rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.session import local_frame, stage

ACTUAL, PREDICTED = "actual", "predicted"
METRIC_SCHEMA = (
    "experiment string, model string, split string, class string, metric string, value double"
)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where it is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def pair_counts(df: DataFrame, actual: str | Column, predicted: str | Column) -> DataFrame:
    """(actual, predicted, n): the one shuffle every count metric needs."""
    a = ref(actual) if isinstance(actual, str) else actual
    p = ref(predicted) if isinstance(predicted, str) else predicted
    return df.groupBy(a.alias(ACTUAL), p.alias(PREDICTED)).agg(F.count(F.lit(1)).alias("n"))


def pairs_of(confusion: Sequence[Sequence[int]], classes: Sequence, spark) -> DataFrame:
    """Pair counts from a finished confusion matrix (rows actual, columns predicted)."""
    rows = [
        (a, p, int(confusion[i][j]))
        for i, a in enumerate(classes)
        for j, p in enumerate(classes)
    ]
    kind = "int" if isinstance(classes[0], int) else "string"
    return local_frame(spark, rows, f"{ACTUAL} {kind}, {PREDICTED} {kind}, n bigint")


def seen_classes(pairs: DataFrame) -> DataFrame:
    """Classes which occur as actual or predicted."""
    return pairs.select(F.explode(F.array(ACTUAL, PREDICTED)).alias("class")).distinct()


def confusion(pairs: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """Full grid (actual, predicted, n), zero cells included."""
    if classes is None:
        names = seen_classes(pairs).agg(F.array_sort(F.collect_set("class")).alias("names"))
    else:
        names = pairs.sparkSession.range(1).select(F.array(*[F.lit(c) for c in classes]).alias("names"))
    grid = names.select("names", F.explode("names").alias(ACTUAL)).select(
        ACTUAL, F.explode("names").alias(PREDICTED)
    )
    return grid.join(pairs, [ACTUAL, PREDICTED], "left").select(
        ACTUAL, PREDICTED, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col(ACTUAL) == F.col(PREDICTED), F.col("n")).otherwise(0))
    return pairs.agg(ratio(right, F.sum("n")).alias("accuracy"))


def binary_metrics(pairs: DataFrame, positive=1) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1, far."""
    hit, call = F.col(ACTUAL) == F.lit(positive), F.col(PREDICTED) == F.lit(positive)

    def cell(mask: Column) -> Column:
        return F.coalesce(F.sum(F.when(mask, F.col("n"))), F.lit(0)).cast("bigint")

    cells = pairs.agg(
        cell(~hit & ~call).alias("tn"),
        cell(~hit & call).alias("fp"),
        cell(hit & ~call).alias("fn"),
        cell(hit & call).alias("tp"),
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.select(
        "tn", "fp", "fn", "tp",
        ratio(F.col("tp") + F.col("tn"), F.expr("tn + fp + fn + tp")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f_score(precision, recall).alias("f1"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("far"),
    )


def class_report(pairs: DataFrame, classes: Sequence | None = None) -> DataFrame:
    """(class, precision, recall, f1, support), for the seen or the given classes."""
    as_actual = F.struct(
        F.col(ACTUAL).alias("class"), F.col("n").alias("support"),
        F.lit(0).cast("bigint").alias("called"),
        F.when(F.col(ACTUAL) == F.col(PREDICTED), F.col("n")).otherwise(0).alias("hits"),
    )
    as_predicted = F.struct(
        F.col(PREDICTED).alias("class"), F.lit(0).cast("bigint").alias("support"),
        F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hits"),
    )
    sums = (
        pairs.select(F.explode(F.array(as_actual, as_predicted)).alias("side"))
        .groupBy("side.class")
        .agg(
            F.sum("side.support").cast("bigint").alias("support"),
            F.sum("side.called").alias("called"),
            F.sum("side.hits").alias("hits"),
        )
    )
    if classes is not None:
        names = pairs.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
        )
        sums = names.join(sums, "class", "left").na.fill(0)
    precision, recall = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f_score(precision, recall).alias("f1"),
        "support",
    )


def averages(report: DataFrame) -> DataFrame:
    """Two rows: macro and weighted averages of a class report."""
    parts = ("precision", "recall", "f1")
    sums = report.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in parts],
        *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in parts],
        F.sum("support").cast("bigint").alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("average"),
                *[F.coalesce(F.col(f"{kind}_{m}"), F.lit(0.0)).alias(m) for m in parts],
                F.coalesce("support", F.lit(0)).alias("support"),
            )
            for kind in ("macro", "weighted")
        ]
    )
    return sums.select(F.inline(rows))


def false_alarm_rate(report: DataFrame, benign) -> DataFrame:
    """Share of benign rows given another class: one minus the benign recall."""
    return report.filter(F.col("class") == F.lit(benign)).select((1 - F.col("recall")).alias("far"))


# Distinct scores which one task puts in order.
RANGE_ROWS = 1 << 18


def average_precision(
    df: DataFrame, hit: str, score: str, group: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Average precision ``sum (R_n - R_(n-1)) P_n`` over the distinct scores.

    Equal scores combine before the shuffle. The distinct scores of all classes are cut
    into ranges of about ``range_rows`` in the order of class and falling score: a
    class with many scores takes many ranges, small classes share one. Running counts
    are taken inside a class's part of a range and shifted by the totals of its
    earlier parts, so no task sorts a whole class. A class without positives scores 0.
    """
    keys = [F.lit("").alias("class")] if group is None else [ref(group).alias("class")]
    counts = (
        df.select(*keys, ref(hit).cast("bigint").alias("hit"), ref(score).cast("double").alias("score"))
        .groupBy("class", "score")
        .agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("rows"))
    )
    counts = stage(counts, "score-counts")
    placed = score_ranges(counts, range_rows)
    part = ["class", "range"]
    totals = placed.groupBy(*part).agg(F.sum("hits").alias("_hits"), F.sum("rows").alias("_rows"))
    # A row per range: a class's scores divided by ``range_rows``.
    earlier = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_{c}") for c in part],
        F.coalesce(F.sum("_hits").over(earlier), F.lit(0)).alias("_hits_above"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_above"),
    )
    inside = Window.partitionBy(*part).orderBy(F.desc("score"))
    at_score = (
        placed.withColumn("_h", F.sum("hits").over(inside))
        .withColumn("_n", F.sum("rows").over(inside))
        .join(offsets, F.col("class").eqNullSafe(F.col("_class")) & (F.col("range") == F.col("_range")))
    )
    precision = (F.col("_h") + F.col("_hits_above")) / (F.col("_n") + F.col("_rows_above"))
    result = at_score.groupBy("class").agg(
        ratio(F.sum(F.col("hits") * precision), F.sum("hits")).alias("average_precision"),
        F.sum("hits").alias("positives"),
    )
    return result.drop("class") if group is None else result.withColumnRenamed("class", group)


def score_ranges(counts: DataFrame, range_rows: int) -> DataFrame:
    """``counts`` (class, score and more), stored with the number of its range in ``range``.

    Ranges follow each other in the order of class and falling score. They are stored
    because a range is the partition it was sorted into: a later run may cut elsewhere.
    """
    ranges = max(1, math.ceil(counts.count() / range_rows))
    cut = counts.repartitionByRange(ranges, "class", F.desc("score"))
    return stage(cut.withColumn("range", F.spark_partition_id()), "score-ranges")


def macro_average_precision(df: DataFrame, group: str, hit: str, score: str) -> DataFrame:
    per_class = average_precision(df, hit, score, group)
    return per_class.agg(F.avg("average_precision").alias("macro_average_precision"))


def metric_rows(
    df: DataFrame, experiment: str, model: str, split: str, values: Sequence[str],
    class_column: str | None = None,
) -> DataFrame:
    """Wide metric columns to the long table of ``METRIC_SCHEMA``."""
    name = F.lit("") if class_column is None else ref(class_column).cast("string")
    cells = F.array(
        *[F.struct(F.lit(v).alias("metric"), ref(v).cast("double").alias("value")) for v in values]
    )
    return df.select(
        F.lit(experiment).alias("experiment"),
        F.lit(model).alias("model"),
        F.lit(split).alias("split"),
        name.alias("class"),
        F.inline(cells),
    )


def constant_rows(
    spark, experiment: str, model: str, split: str, values: dict[str, float]
) -> DataFrame:
    rows = [
        (experiment, model, split, "", k, float(v) if v is not None else math.nan)
        for k, v in values.items()
    ]
    return local_frame(spark, rows, METRIC_SCHEMA)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


AVERAGES = tuple(f"{kind}_{m}" for kind in ("macro", "weighted") for m in ("precision", "recall", "f1"))


def summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per experiment, model and split; a column per overall metric, and the macro
    and weighted averages of precision, recall and F1."""
    kind = F.regexp_extract("class", "^(macro|weighted) avg$", 1)
    named = rows.filter((F.col("class") == "") | (kind != "")).withColumn(
        "metric", F.when(kind != "", F.concat_ws("_", kind, "metric")).otherwise(F.col("metric"))
    )
    return named.groupBy("experiment", "model", "split").pivot("metric", [*metrics, *AVERAGES]).agg(
        F.max("value")
    )
