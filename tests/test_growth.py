"""What must not grow with the table, or faster than it."""

import contextlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import isolation, models, neighbours
from flowsieve.operators.isolation import IsolationForest, tree_samples
from flowsieve.operators.models import Classifier, fit_forest
from flowsieve.operators.quantiles import STRIDE, OrderStatistics, _thinned, quantiles
from flowsieve.operators.scoring import scorer
from flowsieve.operators.smote import smote
from flowsieve.plans import queries

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(3000)]
    cloud = spark.createDataFrame(rows, "id int, x double, y double").repartition(4)
    return cloud.withColumn("label", F.when(F.col("x") > 0.5, "right").when(F.col("y") > 0, "top").otherwise("BENIGN"))


def test_forest_of_several_fits(spark, labelled, tmp_path, monkeypatch):
    """Trees fitted in groups are one forest: its scores, storage and arrays agree."""
    monkeypatch.setattr(models, "FIT_CELLS", 1)
    monkeypatch.setattr(models, "FIT_TREES", 3)
    assert models.tree_groups(8, 3000) == [3, 3, 2]
    model = fit_forest(labelled, "label", FEATURES, trees=8, depth=6)
    assert [one.getNumTrees for one in model.model] == [3, 3, 2]
    scored = model.predict(labelled)
    assert scored.filter("label = prediction").count() > 2700
    rows = scored.select(*FEATURES, "scores").toPandas()
    found = np.stack(rows["scores"])
    np.testing.assert_allclose(found.sum(axis=1), 1.0, rtol=1e-9)
    np.testing.assert_allclose(scorer(spark, model).scores(rows[FEATURES].to_numpy()), found, rtol=1e-9, atol=1e-12)
    model.save(spark, str(tmp_path / "forest"))
    again = Classifier.load(spark, str(tmp_path / "forest")).predict(labelled).select("id", "prediction", "scores")
    assert again.exceptAll(scored.select("id", "prediction", "scores")).isEmpty()


def test_forest_groups_follow_the_rows(labelled, monkeypatch):
    """Few trees are fitted together on a large table, and node numbers are not checkpointed."""
    assert models.tree_groups(100, 480_000) == [100] and max(models.tree_groups(100, 28_800_000)) == 10
    asked = []
    plain = models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **given: asked.append(given) or plain(**given))
    monkeypatch.setattr(models, "FIT_CELLS", 6_000)
    monkeypatch.setattr(models, "FIT_TREES", 2)
    fit_forest(labelled, "label", FEATURES, trees=5, depth=3)
    assert [a["numTrees"] for a in asked] == [2, 2, 1] and all(a["checkpointInterval"] == -1 for a in asked)
    assert len({a["seed"] for a in asked}) == 3


def test_draws_are_not_broadcast(spark):
    """The join of the draws is planned by their number, not by that of the classes."""
    rng = np.random.default_rng(3)
    few, many = rng.normal(size=(12, 2)), rng.normal(size=(40_000, 2))
    rows = pd.DataFrame(np.vstack([few, many]), columns=FEATURES).assign(label=["few"] * 12 + ["many"] * 40_000)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        raised = smote(spark.createDataFrame(rows), "label", FEATURES)
        with contextlib.redirect_stdout(told := io.StringIO()):
            raised.explain()
    finally:
        spark.conf.set(name, before)
    joins = [line for line in told.getvalue().splitlines() if "Join" in line and "salt" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins), joins


def test_routed_rows_leave_in_small_batches(monkeypatch):
    """A row that goes to every cell is not copied for all of them at once."""
    monkeypatch.setattr(neighbours, "ROUTED_CELLS", 64)
    rng = np.random.default_rng(4)
    pivots = {0: rng.normal(size=(50, 4))}

    class Rows:
        """As much of a table as ``_route`` touches: it keeps the function of the tasks."""

        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))

        def mapInPandas(self, run, schema):
            return run

    run = neighbours._route(Rows(), pivots, {(0, i): (10, 100.0) for i in range(50)})
    part = pd.DataFrame({"cls": 0, "ord": range(30), "x": list(rng.normal(size=(30, 4))), "cell": np.int32(0), "limit": np.nan})
    sizes = [len(out) for out in run(iter([part]))]
    assert sum(sizes) == 30 * 49 and max(sizes) <= 16


def test_tree_samples_read_the_table_twice(spark):
    """Hashes are counted once and the rows near the sample stored once; the sample is the same."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(i):
        read.add(1)
        return i

    plain = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 89).cast("double").alias("x"))
    # Rows of the first hashes are gone, as after a split by the same hash.
    table = plain.filter(isolation.row_hash(7, ["id"]) > "4")
    drawn, taken = tree_samples(table.select(seen("id").alias("id"), "x"), ["x"], ["id"], 5, 16, 7)
    found = sorted(r["x"][0] for r in drawn.collect())
    assert taken == 16 and read.value <= 2.5 * table.count()
    assert found == sorted(r["x"] for r in isolation.take_n(table, 80, ["id"], 7).collect())


def test_sketches_are_fed_steps_of_sorted_runs(spark, monkeypatch):
    """A large table's sketches see one value in so many; quantiles stay exact, whatever the partitions."""
    rng = np.random.default_rng(6)
    n = 60_000
    x = np.exp(rng.normal(size=n) * 3)
    rows = pd.DataFrame({"id": range(n), "x": x, "few": np.where(np.arange(n) < 50, x, np.nan), "same": 2.5, "up": np.sort(x)})
    plain = spark.createDataFrame(rows)
    table = plain.select("id", "x", F.when(F.col("id") < 50, F.col("few")).alias("few"), "same", "up").withColumn("none", F.lit(None).cast("double"))
    kept = _thinned(table.select("x", "same"), STRIDE).groupBy("col").agg(F.count("value").alias("kept"), F.sum("n").alias("n")).collect()
    assert all(abs(r["kept"] * STRIDE - n) <= 32 * STRIDE and r["n"] == n for r in kept) and len(kept) == 2
    fed = []
    given = OrderStatistics.__init__.__globals__["_thinned"]
    monkeypatch.setitem(OrderStatistics.__init__.__globals__, "_thinned", lambda *a: fed.append(a[1]) or given(*a))
    probs = [0.0, 0.15, 0.5, 0.999, 1.0]
    for parts in (1, 7, 300):  # runs of 200 rows at last
        found = quantiles(table.repartition(parts, "id"), ["x", "few", "same", "up", "none"], probs)
        for c, values in (("x", x), ("few", x[:50]), ("same", np.full(n, 2.5)), ("up", x)):
            np.testing.assert_allclose(found[c], np.quantile(values, probs), rtol=1e-12, err_msg=f"{c} {parts}")
        assert found["none"] == [None] * len(probs)
    assert fed == [3, 3, 3]


def test_stored_hashes_sample_as_fresh_ones(spark, sf_dir, monkeypatch):
    """A prepared table keeps its hashes, so sampling from it hashes only the rows near the sample."""
    data = queries._shared_data(spark, sf_dir)
    fresh = IsolationForest.fit(data.train, data.features, queries.LINEITEM_KEY, trees=3, sample_rows=16)
    hashed = []
    plain = isolation.row_hash
    monkeypatch.setattr(isolation, "row_hash", lambda *a: hashed.append(a) or plain(*a))
    train, order = data.hashed_train(queries.LINEITEM_KEY)
    again = IsolationForest.fit(train, data.features, queries.LINEITEM_KEY, trees=3, sample_rows=16, order=order)
    assert again == fresh and len(hashed) == 1  # of the drawn rows
    assert train.columns == [*data.train.columns, order] and order not in data.table.columns
    assert data.hashed_train(queries.LINEITEM_KEY, 7)[1] is None and data.hashed_train(None)[1] is None


def test_training_rows_are_scored_once(spark, sf_dir, monkeypatch):
    """The threshold and the codes of the training rows come from the same scores."""
    scored = []
    plain = IsolationForest.score_column
    monkeypatch.setattr(IsolationForest, "score_column", lambda self, spark: scored.append(1) or plain(self, spark))
    assert {r["split"]: r["near_level"] for r in queries.isolation_fit_predict(spark, sf_dir).collect()} == {"train": True, "test": True}
    assert len(scored) == 1
