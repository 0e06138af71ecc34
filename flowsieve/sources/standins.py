"""Flow-shaped frames made from the general test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import to_number
from flowsieve.sources.flows_csv import UNSW_COLUMNS

LINEITEM_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
VECTOR = [f"f{i}" for i in range(64)]

DIRTY_LABELS = (
    " benign ", None, "", "nan", "Web Attack \u0096 XSS", "Web Attack \u2013 Sql Injection",
    "Web Attack  -  Brute Force", "Unknown", "DoS\u00a0Hulk", "WEB ATTACK SQL INJECTION",
    "\u2003Bot\u00a0", "DDoS",
)
DIRTY_NUMBERS = (
    "1", " 2 ", "Infinity", "-inf", "NaN", "abc", "", " ", "-", "1e3", "0x1", "1d", None,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: Sequence, place: Column) -> Column:
    """The value at ``place`` modulo the list length."""
    listed = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(listed, F.pmod(place, F.lit(len(values))).cast("int"))


def events_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a class, an attack flag and the verdicts of simple rules."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "value",
        to_number(F.get_json_object("props", "$.k")).alias("k"),
        "event_type",
        (F.col("event_type") == "error").cast("int").alias("is_attack"),
        (value > 60).cast("int").alias("rule"),
        F.floor(value).cast("double").alias("rule_score"),
        pick(("click", "error", "purchase", "signup", "view"), F.col("user_id")).alias("rule_class"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(labels, "doc_id", "left")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with label and number cells as dirty as raw flow files have them."""
    place = F.col("event_id")
    dirty = pick(DIRTY_NUMBERS, place)
    return table(spark, sf_dir, "events").select(
        "event_id",
        pick(DIRTY_LABELS, place).alias("label"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" "), F.col("value").cast("string")))
        .otherwise(dirty)
        .alias("amount"),
    )


def vector_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        "vec_id", "label",
        *[F.get("embedding", i).cast("double").alias(f) for i, f in enumerate(VECTOR)],
    )


def holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with missing prices, a column without values and a constant one."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        (F.col("o_custkey") % 100).cast("double").alias("customer"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(9.0)).otherwise(F.lit(3.0)).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
    )


def lineitem_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the shared feature schema; attacks are the dear ones."""
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        *LINEITEM_KEY,
        price.alias("duration"),
        quantity.alias("src_packets"),
        F.col("l_linenumber").cast("double").alias("dst_packets"),
        (quantity * 64).alias("src_bytes"),
        (F.col("l_partkey") % 1500).cast("double").alias("dst_bytes"),
        (price / quantity).alias("src_mean_packet_sz"),
        (F.col("l_tax") * 100).alias("dst_mean_packet_sz"),
        (F.col("l_discount") * 1000).alias("src_iat_mean"),
        (F.col("l_suppkey") % 100).cast("double").alias("dst_iat_mean"),
        (price > 60000).cast("int").alias("is_attack"),
    )


def events_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shared feature schema; attacks are the large ones."""
    value = F.col("value")
    return events_flows(spark, sf_dir).select(
        "event_id",
        (value * 1000).alias("duration"),
        (F.col("k") + 1).alias("src_packets"),
        (F.col("user_id") % 7).cast("double").alias("dst_packets"),
        ((F.col("k") + 1) * 64).alias("src_bytes"),
        (F.col("user_id") * 10).cast("double").alias("dst_bytes"),
        (value * 20).alias("src_mean_packet_sz"),
        (F.col("k") % 9).alias("dst_mean_packet_sz"),
        value.alias("src_iat_mean"),
        F.col("k").alias("dst_iat_mean"),
        (value > 60).cast("int").alias("is_attack"),
    )


CIC_HEADER = (
    "Flow ID", " Source IP", "Flow Duration", " Total Fwd Packets", "Total Backward Packets ",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Mean",
    "Bwd Packet Length Mean", "Fwd IAT Mean", " Bwd IAT Mean", " Label",
)


def cic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw headered flows: text cells of integers, dirty labels."""
    n = F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")
    cells = [
        F.concat_ws("-", *LINEITEM_KEY),
        F.concat(F.lit("10.0.0."), F.col("l_suppkey")),
        F.when(n % 19 == 0, F.lit("Infinity")).otherwise(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")),
        F.col("l_quantity").cast("int").cast("string"),
        F.when(n % 23 != 0, F.col("l_linenumber").cast("string")),
        (F.col("l_quantity") * 64).cast("int").cast("string"),
        (F.col("l_partkey") % 1500).cast("string"),
        (F.col("l_partkey") % 97).cast("string"),
        F.when(n % 29 == 0, F.lit("abc")).otherwise((F.col("l_suppkey") % 10).cast("string")),
        F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        F.lit("7"),
        pick(("BENIGN", "benign", "DoS Hulk", None, "PortScan", "DDoS", "Unknown", " Bot"), n),
    ]
    return table(spark, sf_dir, "lineitem").select(*[c.alias(h) for c, h in zip(cells, CIC_HEADER)])


UNSW_ATTACKS = (None, None, None, " Fuzzers ", "DoS", "Backdoor", "Backdoors")


def unsw_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw headerless flows: 49 text columns of integers and names."""
    n = F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")
    special = {
        "srcip": F.concat(F.lit("10.0."), F.col("l_suppkey")),
        "sport": F.col("l_linenumber"),
        "dstip": F.concat(F.lit("10.1."), F.col("l_partkey")),
        "dsport": F.col("l_orderkey"),
        "proto": pick(("tcp", "udp", "arp", "ospf"), F.col("l_partkey")),
        "state": F.col("l_linestatus"),
        "service": pick(("-", "dns", "http"), F.col("l_suppkey")),
        "attack_cat": pick(UNSW_ATTACKS, n),
        "Label": F.when(F.pmod(n, F.lit(7)) < 3, F.lit(0)).otherwise(F.lit(1)),
        "sbytes": F.when(n % 31 == 0, F.lit(" ")).otherwise((F.col("l_quantity") * 64).cast("int").cast("string")),
        "ct_ftp_cmd": F.when(n % 5 == 0, F.lit("-")).otherwise(F.lit("1")),
    }
    cells = [
        special.get(c, (F.col("l_partkey") * (i + 1) + F.col("l_linenumber")) % (90 + i))
        for i, c in enumerate(UNSW_COLUMNS)
    ]
    return table(spark, sf_dir, "lineitem").select(
        *[c.cast("string").alias(h) for c, h in zip(cells, UNSW_COLUMNS)]
    )
