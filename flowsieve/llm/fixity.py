"""WARC fixity: Merkle trees over records and ordered offset ranges, and an audit of
replicas that descends only where hashes differ."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.common import staged

#: A file takes no further record from here on; bytes of the lowest range; ranges in the next one up.
FILE_BYTES, RANGE_BYTES, FANOUT = 1 << 26, 1 << 16, 16


def warc_record(page_id, url: str | None, html: str | None) -> bytes:
    """One WARC/1.0 resource record. Nulls count as empty."""
    body = (html or "").encode()
    head = (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def archive(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as records of WARC files: file, offset, page_id, record.

    Every task fills files of its own, one after the other, so no key decides on the
    size of a file and nothing is shuffled. Written once and read back.
    """
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("offset", T.LongType()), pages.schema["page_id"], T.StructField("record", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            ids, files, offsets, records = batch.column("page_id"), [], [], []
            for page_id, url, html in zip(ids, batch.column("url"), batch.column("html")):
                if at >= FILE_BYTES:
                    file, at = file + 1, 0
                record = warc_record(page_id.as_py(), url.as_py(), html.as_py())
                files.append(file), offsets.append(at), records.append(record)
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(offsets, pa.int64()), ids.cast(arrow.field("page_id").type), pa.array(records, pa.binary())], schema=arrow)

    return staged(pages.select("page_id", "url", "html").mapInArrow(write, schema), "archive")


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, page_id, length and SHA-256 of each record: digests only from here on."""
    return records.select("file", "offset", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))


def tree(leaf_rows: DataFrame, levels: int) -> DataFrame:
    """Nodes (file, level, node, hash). A node of level 1 hashes the records that begin in a
    range of ``RANGE_BYTES``, in order, with their offsets and lengths; a higher one the
    ``FANOUT`` ranges below it. Repeated records of one place hash in order of their hashes.
    """
    rows = leaf_rows.select("file", F.floor(F.col("offset") / RANGE_BYTES).alias("node"), F.struct("offset", "length", "hash").alias("part"))
    nodes = None
    for level in range(1, levels + 1):
        parts = F.array_sort(F.collect_list("part"))
        told = F.transform(parts, lambda p: F.to_json(p))
        rows = rows.groupBy("file", "node").agg(F.sha2(F.array_join(told, "\n"), 256).alias("hash"))
        here = rows.select("file", F.lit(level).alias("level"), "node", "hash")
        nodes = here if nodes is None else nodes.unionByName(here)
        rows = rows.select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.struct("node", "hash").alias("part"))
    return nodes


def depth() -> int:
    """Levels of a tree whose root spans a whole file."""
    levels = 1
    while RANGE_BYTES * FANOUT ** (levels - 1) < FILE_BYTES:
        levels += 1
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which ``replica`` differs from ``primary`` (both: file, offset, page_id,
    record): file, offset, page_id, status, length, expected, found.

    Roots are compared first, below a differing node its children, down to ranges, and in
    a differing range its records; equal branches are never entered. status is
    ``corrupt`` (other bytes at the same place), ``missing`` (nothing at that place of the
    replica) or ``extra`` (nothing at that place of the primary). Null urls and texts make records of
    empty text, repeated pages a record each; other columns are ignored; empty archives
    give an empty result.
    """
    levels = depth()
    rows = {s: staged(leaves(r), f"leaves-{s}") for s, r in (("a", primary), ("b", replica))}
    trees = {s: staged(tree(r, levels), f"tree-{s}") for s, r in rows.items()}
    differing: DataFrame | None = None
    for level in range(levels, 0, -1):
        a, b = (trees[s].where(F.col("level") == level).select("file", "node", F.col("hash").alias(s)) for s in "ab")
        if differing is not None:
            above = differing.select(F.col("file").alias("f"), F.col("node").alias("up"))
            a, b = (x.join(above, (x["file"] == F.col("f")) & (F.floor(x["node"] / FANOUT) == F.col("up")), "left_semi") for x in (a, b))
        differing = staged(a.join(b, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node"), "differing")
    sides = []
    for s, value in (("a", "expected"), ("b", "found")):
        inside = rows[s].withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(differing, ["file", "node"], "left_semi")
        sides.append(inside.select("file", "offset", F.col("page_id").alias(f"page_{s}"), F.col("length").alias(f"length_{s}"), F.col("hash").alias(value)))
    both = sides[0].join(sides[1], ["file", "offset"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return both.select("file", "offset", F.coalesce("page_a", "page_b").alias("page_id"), status.alias("status"), F.coalesce("length_a", "length_b").alias("length"), "expected", "found")
