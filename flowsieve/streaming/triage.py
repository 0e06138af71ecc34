"""Two-stage triage of arriving flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from flowsieve.operators.cascade import cascade_rows
from flowsieve.operators.isolation import IsolationForest
from flowsieve.operators.models import Classifier
from flowsieve.operators.prep import FeaturePrep, OneHot


def prepared(stream: DataFrame, prep: FeaturePrep, one_hot: OneHot | None = None) -> DataFrame:
    """Encode, impute and scale with statistics fitted on training rows."""
    return prep.transform(one_hot.transform(stream) if one_hot else stream)


def triage_stream(
    stream: DataFrame,
    prep: FeaturePrep,
    detector: IsolationForest,
    classifier: Classifier,
    benign,
    out: str,
    checkpoint: str,
    one_hot: OneHot | None = None,
) -> StreamingQuery:
    """Write the flag and class of each arriving flow to the parquet folder ``out``.

    Every micro-batch goes to a folder of its own number and overwrites it when
    the batch is repeated after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        with cascade_rows(batch, detector, classifier, benign) as final:
            final.write.mode("overwrite").parquet(f"{out}/batch={number}")

    ready = prepared(stream, prep, one_hot)
    return (
        ready.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
