"""Two-stage triage: a detector passes on what looks unusual, a classifier names it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.operators.isolation import IsolationForest
from flowsieve.operators.metrics import ratio
from flowsieve.operators.models import Classifier
from flowsieve.operators.scoring import scorer


def combine(flagged: Column, second: Column, benign) -> Column:
    """Flagged rows take the class of the second stage, all others are benign."""
    return F.when(F.coalesce(flagged, F.lit(False)), second).otherwise(F.lit(benign))


def routing(df: DataFrame, flagged: Column) -> DataFrame:
    """One row: rows sent to the second stage, rows let through, and their shares."""
    sent = F.count_if(flagged)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("rows"),
        sent.alias("flagged"),
        (total - sent).alias("bypassed"),
        ratio(sent, total).alias("flagged_share"),
        ratio(total - sent, total).alias("bypassed_share"),
    )


def apply_cascade(
    test: DataFrame,
    detector: IsolationForest,
    classifier: Classifier,
    benign,
    out: str = "prediction",
    flag: str = "flagged",
) -> DataFrame:
    """Add the flag and the final class, from one pass over the rows.

    A batch is scored by the detector once; only its flagged rows reach the classifier.
    """
    spark = test.sparkSession
    if detector.offset is None:
        raise ValueError("the forest has no offset yet")
    columns = list(dict.fromkeys([*detector.features, *classifier.features]))
    first = [columns.index(f) for f in detector.features]
    second = [columns.index(f) for f in classifier.features]
    shared = spark.sparkContext.broadcast((detector.scorer(), scorer(spark, classifier)))
    offset = detector.offset

    @F.pandas_udf("flagged boolean, best int")
    def stages(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        detect, classify = shared.value
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype=float) for s in batch])
            flagged = detect(x[:, first]) < offset
            best = np.full(len(x), -1, dtype=np.int32)
            if flagged.any():
                best[flagged] = classify.scores(x[flagged][:, second]).argmax(axis=1)
            yield pd.DataFrame({"flagged": flagged, "best": best})

    # Not to be pushed below a later filter, which would score every row once more.
    staged = test.withColumn("_stages", stages.asNondeterministic()(*[ref(c).cast("double") for c in columns]))
    names = F.array(*[F.lit(c) for c in classifier.classes])
    final = combine(F.col("_stages.flagged"), F.get(names, F.col("_stages.best")), benign)
    return staged.withColumns({flag: F.col("_stages.flagged"), out: final}).drop("_stages")


@contextmanager
def cascade_rows(
    test: DataFrame,
    detector: IsolationForest,
    classifier: Classifier,
    benign,
    out: str = "prediction",
    flag: str = "flagged",
) -> Iterator[DataFrame]:
    """``apply_cascade`` with its result held while the block runs, and freed after it."""
    both = apply_cascade(test, detector, classifier, benign, out, flag).persist()
    try:
        yield both
    finally:
        both.unpersist()
