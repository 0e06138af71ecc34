import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import metrics as M

# Published confusion counts (benign row, attack row) and the scores published with them.
PUBLISHED = [
    ([[447134, 7485], [2010, 167240]], 0.9847804587, 0.0164643361),
    ([[2218764, 0], [321283, 0]], 0.8735129707, 0.0),
]


@pytest.mark.parametrize("counts,accuracy,far", PUBLISHED)
def test_published_counts(spark, counts, accuracy, far):
    pairs = M.pairs_of(counts, [0, 1], spark)
    row = M.binary_metrics(pairs).first()
    (tn, fp), (fn, tp) = counts
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (tn, fp, fn, tp)
    assert row["accuracy"] == pytest.approx(accuracy, abs=1e-9)
    assert row["far"] == pytest.approx(far, abs=1e-9)
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn)
    assert row["precision"] == pytest.approx(precision)
    assert row["recall"] == pytest.approx(recall)
    assert row["f1"] == pytest.approx(2 * precision * recall / (precision + recall) if tp else 0.0)
    report = {r["class"]: r for r in M.class_report(pairs).collect()}
    assert report[0]["support"] == tn + fp and report[1]["support"] == fn + tp
    assert M.false_alarm_rate(M.class_report(pairs), 0).first()["far"] == pytest.approx(far, abs=1e-9)
    weighted = M.averages(M.class_report(pairs)).filter("average = 'weighted avg'").first()
    assert weighted["recall"] == pytest.approx(accuracy, abs=1e-9)


def test_grid_holds_zero_cells(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "c")], "y string, p string")
    grid = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion(M.pair_counts(df, "y", "p")).collect()}
    assert len(grid) == 9 and grid["a", "b"] == 2 and grid["c", "c"] == 1 and sum(grid.values()) == 3


def test_report_of_given_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    report = M.class_report(M.pair_counts(df, "y", "p"), ["a", "zz"]).collect()
    assert {r["class"]: (r["precision"], r["support"]) for r in report} == {"a": (0.5, 1), "zz": (0.0, 0)}


def plain_ap(hits, scores):
    total, found, best = sum(hits), 0, 0.0
    for s in sorted(set(scores), reverse=True):
        here = sum(h for h, x in zip(hits, scores) if x == s)
        found += here
        best += here * found / sum(x >= s for x in scores)
    return best / total if total else 0.0


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5)], "y int, s double")
    assert M.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(0.805556, abs=1e-6)


def test_average_precision_per_class(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, rate, kind in (("ties", 0.3, "ties"), ("none", 0.0, "real"), ("many", 0.6, "real")):
        for _ in range(3000 if name == "many" else 500):
            s = float(rng.integers(0, 5)) if kind == "ties" else float(rng.lognormal(0, 4))
            rows.append((name, int(rng.random() < rate), s))
    df = spark.createDataFrame(rows, "c string, y int, s double").repartition(5)
    got = {r["c"]: r["average_precision"] for r in M.average_precision(df, "y", "s", "c").collect()}
    for name in ("ties", "none", "many"):
        part = [(h, s) for c, h, s in rows if c == name]
        assert got[name] == pytest.approx(plain_ap(*zip(*part)))
    macro = M.macro_average_precision(df, "c", "y", "s").first()[0]
    assert macro == pytest.approx(sum(got.values()) / 3)


@pytest.mark.parametrize("range_rows", [40, 700, 1 << 18])
def test_ranges_follow_the_distinct_scores(spark, range_rows):
    rng = np.random.default_rng(11)
    sizes = {"large": 4000, "other": 1500, None: 300, **{f"small{i}": 4 for i in range(60)}}
    rows = [(c, int(rng.random() < 0.4), float(s)) for c, n in sizes.items() for s in rng.lognormal(0, 3, n).round(4)]
    rows += [("large", 1, float("nan")), ("large", 0, float("inf")), ("other", 1, -0.0), ("other", 0, 0.0)]
    df = spark.createDataFrame(rows, "c string, y int, s double").repartition(7)
    got = {r["c"]: r["average_precision"] for r in M.average_precision(df, "y", "s", "c", range_rows).collect()}
    assert got.keys() == sizes.keys()
    for name in sizes:
        part = [(h, 1e300 if s == np.inf else 1e301 if np.isnan(s) else s) for c, h, s in rows if c == name]
        assert got[name] == pytest.approx(plain_ap(*zip(*part)))
    counts = df.groupBy(F.col("c").alias("class"), F.col("s").alias("score")).count()
    cut = M.score_ranges(counts, range_rows).groupBy("range").count().toPandas()
    assert cut["count"].max() <= 3 * range_rows and len(cut) >= counts.count() // (2 * range_rows)


def test_summary_has_a_row_per_model(spark):
    rows = M.union_all(
        [M.constant_rows(spark, "e", m, "test", {"accuracy": a, "f1": None}) for m, a in (("x", 0.5), ("y", 0.7))]
    )
    got = {r["model"]: r["accuracy"] for r in M.summary(rows, ["accuracy"]).collect()}
    assert got == {"x": 0.5, "y": 0.7}
