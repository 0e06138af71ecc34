"""Session helpers: shared work folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A frame of at most this many rows and bytes may be pinned on the driver and broadcast.
SMALL_ROWS, SMALL_BYTES = 20_000, 8 << 20
# Row groups of staged tables: small enough that a file of one task is read by several.
GROUP_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; a cluster
    has to name a folder every executor can reach.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowsieve-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Compile wide projections as methods the JVM will optimise.

    One method for hundreds of column expressions stays interpreted; with this
    limit Spark splits it. The session gets its own value back.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: cuts lineage, survives lost executors.

    Row groups are small, so a table written by few tasks is still read by many.
    """
    path = scratch_path(df.sparkSession, name)
    with small_methods(df.sparkSession):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, wherever the driver was started from."""
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="flowsieve-package-")) / "flowsieve"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))


def arrow_table(rows: Sequence[Sequence], schema: T.StructType) -> pa.Table:
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return pa.Table.from_arrays(columns, schema=arrow)


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A few driver rows as a frame the JVM holds itself: reading it starts no Python worker."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.createDataFrame(arrow_table(rows, schema), schema)


class Pinned:
    """A small frame computed once.

    Up to ``limit`` rows of at most ``SMALL_BYTES`` are held on the driver and
    broadcast. Anything larger is checkpointed reliably and joined without a
    hint, so the size of a broadcast never follows the data.
    """

    def __init__(self, df: DataFrame, limit: int = SMALL_ROWS):
        spark = df.sparkSession
        rows = df.limit(limit + 1).collect()
        self.rows: list[Row] | None = None
        if len(rows) <= limit and arrow_table(rows, df.schema).nbytes <= SMALL_BYTES:
            self.rows = rows
            self.frame = local_frame(spark, rows, df.schema)
            self.side = F.broadcast(self.frame)
        else:
            work_dir(spark)
            self.frame = df.checkpoint()
            self.side = self.frame

    @property
    def small(self) -> bool:
        return self.rows is not None

    def highest(self, column: str):
        """The greatest value of a column, None without rows."""
        if self.small:
            return max((r[column] for r in self.rows), default=None)
        return self.frame.agg(F.max(column)).first()[0]

    def any(self, condition: Column) -> bool:
        return not self.frame.filter(condition).isEmpty()
