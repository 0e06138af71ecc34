"""Raw flow tables from CSV files."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import normalise_name, ref, sentinels_to_null
from flowsieve.session import scratch_path

# Cell texts which stand for a missing value in the raw files.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
ENCODING = "ISO-8859-1"

# The 49 columns of the headerless flow files, in file order.
UNSW_COLUMNS = (
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl",
    "dttl", "sloss", "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin",
    "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit",
    "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt", "synack", "ackdat", "is_sm_ips_ports",
    "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst",
    "ct_dst_ltm", "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "attack_cat", "Label",
)


def missing_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells which stand for a missing value become NULL, in all or the named columns."""
    return sentinels_to_null(df, MISSING_TOKENS, columns)


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def unique_names(cells: Sequence[str | None]) -> list[str]:
    """Header cells as column names: repeated ones get .1, .2 and so on."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return names


def header_lines(spark: SparkSession, path_glob: str) -> DataFrame:
    """(path, line): the first line of each file that is not blank, from one job.

    Every file is a task that stops after its first line, so neither the number nor the
    size of the files counts. The session of its own carries the read settings alone.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1")  # files share no partition,
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    lines = (
        own.read.schema(text_schema(["line"]))
        .option("encoding", ENCODING)
        .option("multiLine", True)  # and a file is not split
        .option("sep", "\u0001")
        .option("quote", "")
        .csv(path_glob)
        .select(F.col("_metadata.file_path").alias("path"), "line")
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, line in enumerate(batch.column("line").to_pylist()):
                if line and line.strip():
                    yield batch.slice(at, 1)
                    return

    return lines.mapInArrow(first, text_schema(["path", "line"]))


def header_cells(line: str) -> list[str]:
    """The cells of a header line."""
    return next(csv.reader([line.rstrip("\r")], skipinitialspace=True))


def scan_headered(
    spark: SparkSession,
    path_glob: str,
    keep_spaces: bool = False,
    columns: Sequence[str] | None = None,
    text: Sequence[str] | None = None,
) -> DataFrame:
    """All files of a glob as one all-text table, joined by column name.

    Files are grouped by their header, so the plan has one scan per distinct
    header and not one per file; the headers come from one job. Names are
    normalised before the union; a column a file lacks is NULL there. ``columns``
    keeps only the named ones which some file has. Missing-value cells become NULL
    in all columns, or only in the ``text`` ones where the rest is parsed as
    numbers anyway.
    """
    stored = scratch_path(spark, "headers")
    header_lines(spark, path_glob).write.parquet(stored)
    heads = spark.read.parquet(stored)  # with this session's settings
    lines = heads.groupBy("line").agg(F.min("path").alias("first")).orderBy("first").collect()
    if not lines:
        raise FileNotFoundError(path_glob)
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, _ in lines:
        groups.setdefault(tuple(unique_names(header_cells(line))), []).append(line)
    parts = []
    for header, same in groups.items():
        if len(groups) == 1:
            paths = path_glob
        else:
            paths = [r["path"] for r in heads.filter(F.col("line").isin(same)).select("path").orderBy("path").collect()]
        df = (
            spark.read.schema(text_schema([f"c{i}" for i in range(len(header))]))
            .option("encoding", ENCODING)
            .option("ignoreLeadingWhiteSpace", True)
            .csv(paths, header=True, enforceSchema=True)
        )
        names = unique_names([normalise_name(h, keep_spaces) for h in header])
        df = df.toDF(*names)
        if columns is not None:
            df = df.select(*[ref(c) for c in columns if c in names])
        parts.append(missing_to_null(df, text))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_headerless(
    spark: SparkSession,
    paths: Sequence[str] | str,
    names: Sequence[str] = UNSW_COLUMNS,
    text: Sequence[str] | None = None,
) -> DataFrame:
    """Headerless files with a fixed column list as one all-text table.

    For ``text`` see ``scan_headered``.
    """
    df = (
        spark.read.schema(text_schema(names))
        .option("encoding", ENCODING)
        .csv(paths if isinstance(paths, str) else list(paths), header=False)
    )
    return missing_to_null(df, text)
