import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.cascade import apply_cascade, routing
from flowsieve.operators.isolation import IsolationForest, mean_path
from flowsieve.operators.models import Classifier, fit_boosted, fit_forest, fit_logistic
from flowsieve.operators.scoring import scorer

FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(3000)] + [(3000, 40.0, -40.0)]
    return spark.createDataFrame(rows, "id int, x double, y double").repartition(4)


@pytest.fixture(scope="module")
def forest(cloud):
    return IsolationForest.fit(cloud, FEATURES, ["id"], trees=20, sample_rows=64)


def test_planted_outlier_is_the_most_unusual(cloud, forest):
    assert forest.score(cloud).orderBy("score").first()["id"] == 3000


def test_contamination_share_is_flagged(cloud, forest):
    offsets = forest.offsets(cloud, [0.10, 0.15, 0.20])
    for level, offset in offsets.items():
        flagged = forest.with_offset(offset).predict(cloud).filter("code = -1").count()
        assert abs(flagged - level * 3001) <= 1


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_trees_ignore_partitioning(cloud, forest, parts):
    again = IsolationForest.fit(cloud.repartition(parts), FEATURES, ["id"], trees=20, sample_rows=64)
    assert again.nodes == forest.nodes


def test_scores_equal_a_plain_walk(cloud, forest):
    nodes = {(n[0], n[1]): n for n in forest.nodes}
    for r in forest.score(cloud).limit(20).collect():
        total = 0.0
        for tree in range(forest.trees):
            node = 0
            while nodes[tree, node][2] >= 0:
                _, _, feature, threshold, _, _ = nodes[tree, node]
                node = 2 * node + (1 if r[FEATURES[feature]] <= threshold else 2)
            total += nodes[tree, node][5] + mean_path(nodes[tree, node][4])
        assert r["score"] == pytest.approx(-2 ** (-total / forest.trees / mean_path(64)))


def test_small_table_and_copies(spark):
    few = spark.createDataFrame([(float(i % 3), 1.0) for i in range(30)], "x double, y double")
    small = IsolationForest.fit(few, FEATURES, trees=5)
    assert small.rows == 30 and {n[0] for n in small.nodes} == set(range(5))
    assert all(n[4] == 30 for n in small.nodes if n[1] == 0)
    large = IsolationForest.fit(few, FEATURES, trees=2, sample_rows=4)
    assert large.score(few).filter("score IS NULL").isEmpty()


def test_mean_path():
    assert [mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert mean_path(256) == pytest.approx(10.244770920)


def test_saved_forest_loads_again(spark, cloud, forest, tmp_path):
    forest = forest.with_offset(-0.5)
    forest.save(spark, str(tmp_path / "forest"))
    assert IsolationForest.load(spark, str(tmp_path / "forest")) == forest


@pytest.fixture(scope="module")
def labelled(cloud):
    name = F.when(F.col("x") > 0.5, "right").when(F.col("y") > 0, "top").otherwise("BENIGN")
    return cloud.withColumn("label", name).withColumn("flag", (F.col("x") + F.col("y") > 0).cast("int"))


def right_share(scored, label):
    return scored.filter(F.col(label) == F.col("prediction")).count() / scored.count()


def test_binary_models_learn(spark, labelled, tmp_path):
    for fit, options in ((fit_logistic, {}), (fit_forest, {"trees": 10, "depth": 5})):
        model = fit(labelled, "flag", FEATURES, **options)
        scored = model.predict(labelled)
        assert right_share(scored, "flag") > 0.9
        assert scored.filter((F.get("scores", 1) > 0.5) != (F.col("prediction") == 1)).isEmpty()
        model.save(spark, str(tmp_path / model.kind))
        again = Classifier.load(spark, str(tmp_path / model.kind))
        assert again.predict(labelled).select("id", "prediction").exceptAll(scored.select("id", "prediction")).isEmpty()


@pytest.fixture(scope="module")
def boosted(labelled):
    return fit_boosted(labelled, "label", FEATURES, balanced=True, rounds=3, depth=3)


def test_boosted_classes(spark, labelled, boosted, tmp_path):
    assert boosted.classes == ("BENIGN", "right", "top")
    scored = boosted.predict(labelled)
    assert right_share(scored, "label") > 0.95
    assert scored.filter(F.size("scores") != 3).isEmpty()
    boosted.save(spark, str(tmp_path / "boosted"))
    again = Classifier.load(spark, str(tmp_path / "boosted"))
    assert right_share(again.predict(labelled), "label") == right_share(scored, "label")


def test_cascade_routes_and_names(labelled, forest, boosted):
    nothing = apply_cascade(labelled, forest.with_offset(-2.0), boosted, "BENIGN")
    assert nothing.filter("prediction <> 'BENIGN' OR flagged").isEmpty() and nothing.count() == 3001
    everything = apply_cascade(labelled, forest.with_offset(1.0), boosted, "BENIGN")
    assert right_share(everything, "label") == right_share(boosted.predict(labelled), "label")
    some = apply_cascade(labelled, forest.with_offset(forest.offsets(labelled, [0.15])[0.15]), boosted, "BENIGN")
    row = routing(some, F.col("flagged")).first()
    assert row["rows"] == 3001 and row["flagged"] + row["bypassed"] == 3001
    assert row["flagged_share"] == pytest.approx(0.15, abs=0.001)


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_arrays_score_as_the_model(spark, labelled, boosted, kind):
    model = boosted
    if kind == "logistic":
        model = fit_logistic(labelled, "flag", FEATURES)
    if kind == "forest":
        model = fit_forest(labelled, "label", FEATURES, trees=8, depth=6)
    rows = model.predict(labelled).select(*FEATURES, "scores", "prediction").toPandas()
    scores = scorer(spark, model).scores(rows[FEATURES].to_numpy())
    np.testing.assert_allclose(scores, np.stack(rows["scores"]), rtol=1e-9, atol=1e-12)
    assert [model.classes[i] for i in scores.argmax(axis=1)] == rows["prediction"].tolist()


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_cascade_equals_its_two_stages(labelled, forest, boosted, kind):
    """One pass gives the detector's flags, the classifier's classes on flagged rows and no others."""
    model = boosted if kind == "boosted" else fit_forest(labelled, "label", FEATURES, trees=8, depth=6)
    detector = forest.with_offset(forest.offsets(labelled, [0.15])[0.15])
    both = apply_cascade(labelled, detector, model, "BENIGN")
    flags = detector.predict(labelled).select("id", (F.col("code") == -1).alias("f"))
    classes = model.predict(labelled).select("id", F.col("prediction").alias("p"))
    expected = flags.join(classes, "id").select("id", "f", F.when(F.col("f"), F.col("p")).otherwise("BENIGN"))
    assert both.select("id", "flagged", "prediction").exceptAll(expected).isEmpty() and both.count() == 3001
    plan = both.filter("flagged")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_metrics_of_models_equal_plain_figures(spark, labelled):
    """Every metric row of a binary and a multiclass model against plain recomputation."""
    from flowsieve.plans.experiments import score_binary, score_multiclass

    model = fit_forest(labelled, "flag", FEATURES, trees=5, depth=3)
    told = {r["metric"]: r["value"] for r in score_binary(model, labelled, "flag", "e", "m", "test").filter("class = ''").collect()}
    rows = model.predict(labelled).select("flag", "prediction", F.get("scores", 1).alias("s")).toPandas()
    y, p = rows["flag"].to_numpy(), rows["prediction"].to_numpy()
    tp, fp, fn, tn = ((y & p).sum(), ((1 - y) & p).sum(), (y & (1 - p)).sum(), ((1 - y) & (1 - p)).sum())
    expected = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": (y == p).mean(), "precision": tp / (tp + fp), "recall": tp / (tp + fn), "f1": 2 * tp / (2 * tp + fp + fn), "far": fp / (fp + tn), "auc_pr": plain_average_precision(y, rows["s"].to_numpy())}
    for name, value in expected.items():
        assert told[name] == pytest.approx(value, abs=1e-9), name

    model = fit_forest(labelled, "label", FEATURES, trees=5, depth=3)
    classes = sorted(model.classes)
    told = {(r["class"], r["metric"]): r["value"] for r in score_multiclass(model, labelled, "label", classes, "e", "m", "BENIGN").collect()}
    rows = model.predict(labelled).select("label", "prediction", "scores").toPandas()
    y, p, s = rows["label"].to_numpy(), rows["prediction"].to_numpy(), np.stack(rows["scores"])
    areas = []
    for i, c in enumerate(classes):
        hit, called = y == c, p == c
        precision, recall = (hit & called).sum() / called.sum(), (hit & called).sum() / hit.sum()
        got = [told[c, m] for m in ("precision", "recall", "f1", "support")]
        assert got == pytest.approx([precision, recall, 2 * precision * recall / (precision + recall), hit.sum()], abs=1e-9)
        areas.append(plain_average_precision(hit, s[:, list(model.classes).index(c)]))
    assert told["", "accuracy"] == pytest.approx((y == p).mean(), abs=1e-9) and told["", "auc_pr"] == pytest.approx(np.mean(areas), abs=1e-9)
    assert told["", "far"] == pytest.approx((p[y == "BENIGN"] != "BENIGN").mean(), abs=1e-9)


def plain_average_precision(hit, score):
    area, before = 0.0, 0.0
    for cut in sorted(set(score), reverse=True):
        above = score >= cut
        recall = (hit * above).sum() / hit.sum()
        area += (recall - before) * (hit * above).sum() / above.sum()
        before = recall
    return area
