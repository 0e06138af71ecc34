"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.session import scratch_path

# One word: a run of anything but the six ASCII blanks (what bytes.split() splits at).
WORD = r"[^\x20\x09-\x0D]+"


# What operators remember in a Python worker from task to task: by module, how to forget it.
REMEMBERED: dict[str, Callable[[], object]] = {}


def forget_others(module: str) -> None:
    """Free what the operators of other modules left in this worker: it serves all of a job's stages."""
    for name, forget in REMEMBERED.items():
        if name != module:
            forget()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared work folder and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def unit_draw(*keys: Column) -> Column:
    """A number in (0, 1) fixed by the keys, the same on every run and partitioning."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def map_batches(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], fields: list[T.StructField]) -> DataFrame:
    """Apply ``run`` to every Arrow batch of ``df``; ``fields`` are the output columns."""
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(run.__module__)
        for batch in batches:
            if batch.num_rows and (out := run(batch)) is not None and out.num_rows:
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out.columns, arrow)], schema=arrow)

    return df.mapInArrow(apply, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""
