import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.functions.hashing import row_hash
from flowsieve.operators import balance, selection
from flowsieve.operators.split import stratified_split


def frame(spark, sizes: dict, parts: int = 3):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, s string").repartition(parts)


def members(df, split="test"):
    return {r["id"] for r in df.filter(F.col("split") == split).collect()}


SIZES = {"a": 101, "b": 47, "c": 6, "d": 2}


def test_split_is_a_partition_with_exact_quotas(spark):
    out = stratified_split(frame(spark, SIZES), "s", ["id"])
    counts = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert sum(n for (_, split), n in counts.items() if split == "test") == 32  # ceil(0.2 * 156)
    assert {s: counts[s, "train"] + counts.get((s, "test"), 0) for s in SIZES} == SIZES
    assert counts["a", "train"] in (80, 81) and counts["b", "train"] in (37, 38)
    assert out.select("id").distinct().count() == 156


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("fine", [1, 50_000])
def test_split_ignores_partitioning_and_step_size(spark, monkeypatch, parts, fine):
    """Equal to a plain row number over each whole stratum, however it is found."""
    monkeypatch.setattr(selection.find_thresholds, "__defaults__", (fine,))
    monkeypatch.setattr(selection, "STEP_DIGITS", 1 if fine == 1 else 3)
    df = frame(spark, SIZES, parts)
    out = stratified_split(df, "s", ["id"])
    quota = {r["s"]: r["n"] for r in out.filter("split = 'test'").groupBy("s").agg(F.count("id").alias("n")).collect()}
    order = Window.partitionBy("s").orderBy(row_hash(42, ["id"]))
    ranked = df.withColumn("place", F.row_number().over(order)).collect()
    assert members(out) == {r["id"] for r in ranked if r["place"] <= quota.get(r["s"], 0)}


def test_one_dominant_stratum(spark):
    out = stratified_split(frame(spark, {"big": 5000, "small": 10}), "s", ["id"])
    counts = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert counts == {("big", "train"): 4000, ("big", "test"): 1000, ("small", "train"): 8, ("small", "test"): 2}


def test_copies_keep_quotas_and_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "COPY_CHUNK", 7)
    rows = [("x", 1)] * 400 + [("x", i) for i in range(2, 12)] + [("y", 1)] * 90
    df = spark.createDataFrame(rows, "s string, v int")
    out = stratified_split(df, "s")
    assert out.filter("split = 'test'").count() == 100
    assert out.drop("split").exceptAll(df).isEmpty() and df.exceptAll(out.drop("split")).isEmpty()


def test_a_key_which_is_none_is_reported(spark):
    df = spark.createDataFrame([("x", 1, i) for i in range(50)], "s string, v int, w int")
    with pytest.raises(ValueError, match="does not identify"):
        stratified_split(df, "s", ["v"])


def test_single_row_stratum_is_reported(spark):
    with pytest.raises(ValueError, match="two rows"):
        stratified_split(frame(spark, {"a": 10, "b": 1}), "s", ["id"])


def test_null_stratum(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id int, s string")
    out = stratified_split(df, "s", ["id"])
    assert out.filter("s IS NULL AND split = 'test'").count() == 4


def test_stored_order_splits_copies(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)] * 100, "s string, v int").repartition(3)
    df.withColumn("o", selection.stored_order(42, ["s", "v"])).write.parquet(f"{tmp_path}/t")
    out = stratified_split(spark.read.parquet(f"{tmp_path}/t"), "s", order="o")
    assert out.filter("split = 'test'").count() == 20


@pytest.mark.parametrize("copies", [False, True])
def test_thresholds_read_the_rows_twice(spark, copies, monkeypatch):
    """Further digits come from the rows under a cut only, also where most rows are copies."""
    monkeypatch.setattr(selection.find_thresholds, "__defaults__", (10,))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(30_000).select((F.col("id") % 3).alias("s"), F.when(F.col("id") < 25_000 * int(copies), 7).otherwise(F.col("id")).alias("v"))
    rows = df.select(F.col("s").alias(selection.STRATUM), row_hash(42, ["v"]).alias(selection.HASH))
    cuts = selection.find_thresholds(rows.mapInArrow(seen, rows.schema), lambda sizes: sizes.withColumn("want", F.lit(2_000)))
    assert read.value == 2 * 30_000
    for r in cuts.frame.collect():
        hashes = sorted(x[0] for x in rows.where(F.col(selection.STRATUM) == r[0]).select(selection.HASH).collect())
        assert r["cut"] == hashes[1_999] and hashes.index(r["cut"]) + r["take"] == 2_000 and hashes.count(r["cut"]) == r["ties"]


def test_take_n(spark):
    df = frame(spark, {"a": 50, "b": 20})
    assert selection.take_n(df, 7, ["id"]).count() == 7
    assert selection.take_n(df, 700, ["id"]).count() == 70
    down = balance.downsample(df, "s", 5, ["id"])
    assert {r["s"]: r["count"] for r in down.groupBy("s").count().collect()} == {"a": 5, "b": 20}
    first, second = (set(selection.take_n(df.repartition(p), 9, ["id"]).toPandas()["id"]) for p in (1, 8))
    assert first == second


@pytest.mark.parametrize("rows_per_bucket", [1, 1000])
def test_ordinals(spark, rows_per_bucket):
    df = frame(spark, {"a": 120, "b": 30}).withColumn("h", row_hash(1, ["id"]))
    got = selection.ordinals(df, "s", "h", "o", rows_per_bucket)
    plain = df.withColumn("o", F.row_number().over(Window.partitionBy("s").orderBy("h")) - 1)
    assert {(r["id"], r["o"]) for r in got.collect()} == {(r["id"], r["o"]) for r in plain.collect()}


def test_plan_of_a_marked_table_has_no_shuffle(spark):
    """Once the thresholds are known a split is a broadcast comparison."""
    out = stratified_split(spark.range(100).withColumnRenamed("id", "k"), F.col("k") % 2, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_rare_classes_and_weights(spark):
    df = frame(spark, {"five": 5, "six": 6, "seven": 7})
    assert {r["s"] for r in balance.drop_rare(df, "s").select("s").distinct().collect()} == {"six", "seven"}
    assert [(r["s"], r["n"]) for r in balance.rare_classes(df, "s").collect()] == [("five", 5)]
    weighted = balance.balanced_weights(df, "s")
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(18)
    assert weighted.filter("s = 'six'").first()["weight"] == pytest.approx(18 / (3 * 6))
