"""Stored state, freed caches, few passes over copies, and starting from anywhere."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from flowsieve.operators import selection
from flowsieve.operators.isolation import tree_samples
from flowsieve.operators.prep import OneHot
from flowsieve.plans import prepare
from flowsieve.session import Pinned

ROOT = Path(__file__).resolve().parent.parent


def test_one_hot_is_stored_with_the_table(spark, tmp_path):
    rows = [("tcp", float(i), "a" if i % 2 else "b") for i in range(20)] + [(None, 1.0, "a"), ("udp", 2.0, "b")] * 5
    clean = spark.createDataFrame(rows, "proto string, x double, label string")
    data = prepare.fit_and_scale(clean, "label", ["label"], categorical=["proto"])
    data.save(str(tmp_path / "data"))
    again = prepare.load_prepared(spark, str(tmp_path / "data"))
    assert again.one_hot == data.one_hot and again.prep == data.prep
    plain = prepare.Prepared(data.table, data.features, data.prep)
    plain.save(str(tmp_path / "plain"))
    assert prepare.load_prepared(spark, str(tmp_path / "plain")).one_hot is None
    assert OneHot.load(spark, str(tmp_path / "data" / "one-hot")).names() == data.one_hot.names()


def test_copies_need_few_rounds(spark, monkeypatch):
    rounds = []
    under = selection._under
    monkeypatch.setattr(selection, "_under", lambda *a: rounds.append(a[-1]) or under(*a))
    monkeypatch.setattr(selection.find_thresholds, "__defaults__", (1_000,))
    copies = spark.range(60_000).select(F.lit("same").alias("x"))
    assert selection.take_n(copies, 20_000, None).count() == 20_000
    assert len(rounds) <= 2


def test_pinned_frees_its_cache(spark):
    def held():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before = held()
    small, large = Pinned(spark.range(10)), Pinned(spark.range(100), limit=50)
    assert small.small and not large.small and large.frame.count() == 100
    assert held() == before


def test_tree_samples_follow_one_rule(spark):
    for size, trees, rows in ((10, 7, 4), (10, 3, 20), (1000, 5, 8)):
        table = spark.range(size).select("id", F.col("id").cast("double").alias("x"))
        drawn, taken = tree_samples(table, ["x"], ["id"], trees, rows, 1)
        per_tree = {}
        for r in drawn.collect():
            per_tree.setdefault(r["tree"], []).append(r["x"][0])
        assert taken == min(size, rows) and set(per_tree) == set(range(trees))
        assert all(len(v) == len(set(v)) == taken for v in per_tree.values())
        if size >= trees * rows:
            assert len({x for v in per_tree.values() for x in v}) == trees * rows


def test_executors_get_the_package(tmp_path):
    """Workers that do not have the repository on their path still run Arrow functions."""
    script = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from flowsieve.session import ship_package
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship_package(spark)
from flowsieve.functions.columns import normalise_name
print(spark.range(1).mapInPandas(lambda b: (x.assign(id=len(normalise_name(" A b", False))) for x in b), "id long").first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip() == "3"
