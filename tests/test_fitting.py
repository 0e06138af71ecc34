import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.operators import quantiles as Q
from flowsieve.operators.classes import class_dictionary, decode, encode, spread_scores
from flowsieve.operators.prep import QUARTILES, FeaturePrep, OneHot, any_null

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("ranked_rows", [0, 1, 50_000])
def test_small_column(spark, ranked_rows):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    assert Q.quantiles(df, ["x"], [0.25, 0.5, 0.75], ranked_rows=ranked_rows) == {"x": [1.75, 2.5, 4.75]}
    assert Q.quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]} and Q.quantiles(df, [], [0.5]) == {}


@pytest.mark.parametrize("grid", [8, 1000])
@pytest.mark.parametrize("ranked_rows", [5, 50_000])
def test_quantiles_are_exact_on_skew(spark, monkeypatch, ranked_rows, grid):
    """A third of the rows share one value, the tail spans many magnitudes; coarse pins."""
    monkeypatch.setattr(Q, "ACCURACY", 50)
    monkeypatch.setattr(Q, "GRID", grid)
    monkeypatch.setattr(Q, "FINE_GRID", 4)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(1000, 5.0), rng.lognormal(0, 9, 1500), rng.integers(0, 9, 500)])
    y = rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(5)
    got = Q.quantiles(df, ["x", "y"], PROBS, ranked_rows=ranked_rows)
    np.testing.assert_allclose(got["x"], np.quantile(x, PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(y, PROBS), rtol=1e-12)


def test_a_sketch_beyond_its_bound_is_mended(spark, monkeypatch):
    """Pins that miss the wanted ranks cost a further pass, never a wrong value."""
    monkeypatch.setattr(Q.OrderStatistics, "_around", lambda self, c, r: (0, 3))
    df = spark.range(5000).select((F.col("id") * 0.5).alias("x"))
    assert Q.quantiles(df, ["x"], [0.5, 0.9]) == {"x": [1249.75, 2249.55]}


def test_nan_comes_last(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("nan"), -0.0, 4.0)], "x double")
    assert Q.quantiles(df, ["x"], [0.0, 0.5, 0.75]) == {"x": [0.0, 2.0, 4.0]}


def passes(df):
    """``df``, and a function that tells how often all its rows were read."""
    sc, n = df.sparkSession.sparkContext, df.count()
    read = sc.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(seen, df.schema), lambda: read.value / n


def test_fitting_reads_its_input_twice(spark):
    """Quartiles of holed columns, before and after imputation, from two passes; flags from none."""
    rng = np.random.default_rng(8)
    x = rng.lognormal(0, 3, (4000, 6)).round(2)
    x[rng.random((4000, 6)) < [0, 0.01, 0.1, 0.4, 0.6, 0.97]] = np.nan
    rows = [(*[None if np.isnan(v) else float(v) for v in r], "abc"[i % 3]) for i, r in enumerate(x)]
    plain = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, s string").repartition(4)
    encoder = OneHot.fit(plain, ["s"])
    df, read = passes(encoder.transform(plain))
    prep = FeaturePrep.fit(df, flags=encoder.flags())
    assert read() == 2.0
    for i, c in enumerate("abcdef"):
        median = np.nanmedian(x[:, i])
        quarters = np.quantile(np.where(np.isnan(x[:, i]), median, x[:, i]), QUARTILES)
        expected = median, quarters[1], quarters[2] - quarters[0] if quarters[2] - quarters[0] > 1e-9 else 1.0
        np.testing.assert_allclose((prep.median[c], prep.center[c], prep.spread[c]), expected, rtol=1e-12)
    assert prep == FeaturePrep.fit(encoder.transform(plain))
    assert prep.features == list("abcdef") + ["s_b", "s_c"]


def test_approximate_median_is_near(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    assert Q.quantiles(df, ["x"], [0.5], "approx")["x"][0] == pytest.approx(5000, abs=10)
    assert FeaturePrep.fit(df, method="approx").center["x"] == pytest.approx(5000, abs=10)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.integers(0, 3).map(float)), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.quantiles(df, ["x"], [0.25, 0.5], ranked_rows=3)["x"]
    present = [v for v in values if v is not None]
    if not present:
        assert got == [None, None]
    else:
        np.testing.assert_allclose(got, np.quantile(present, [0.25, 0.5]), rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def train(spark):
    rows = [(1.0, 3.0, None), (2.0, 3.0, None), (3.0, 3.0, None), (10.0, 900.0, None), (None, 3.0, None)]
    return spark.createDataFrame(rows, "a double, constant double, empty double")


def test_fit_and_transform(spark, train):
    prep = FeaturePrep.fit(train)
    assert prep.empty == ["empty"] and prep.features == ["a", "constant"]
    assert prep.median["a"] == 2.5
    assert (prep.center["a"], prep.spread["a"]) == (2.5, 1.0)  # after imputation: 1, 2, 2.5, 3, 10
    assert prep.spread["constant"] == 1.0
    other = spark.createDataFrame([(None, 4.0, 1.0, "k")], "a double, constant double, empty double, key string")
    assert [tuple(r) for r in prep.transform(other).collect()] == [(0.0, 1.0, "k")]
    assert [tuple(r) for r in prep.impute(other).collect()] == [(2.5, 4.0, "k")]
    assert any_null(train, ["a", "constant"]).first().asDict() == {"a": True, "constant": False}


def test_saved_statistics_load_again(spark, train, tmp_path):
    prep = FeaturePrep.fit(train)
    prep.save(spark, str(tmp_path / "prep"))
    assert FeaturePrep.load(spark, str(tmp_path / "prep")) == prep


def test_one_hot(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("c", 4)], "s string, v int")
    encoder = OneHot.fit(df, ["s", "absent"])
    assert encoder.names() == ["s_b", "s_c", "s_nan"]
    late = spark.createDataFrame([("b", 1), ("zz", 2), (None, 3), ("a", 4)], "s string, v int")
    out = encoder.transform(late).orderBy("v")
    assert out.columns == ["v", "s_b", "s_c", "s_nan"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_class_dictionary(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    dictionary = class_dictionary(df, "label")
    coded = encode(df, "label", dictionary, "i")
    assert sorted(tuple(r) for r in coded.collect()) == [("a", 0), ("b", 1), ("b", 1)]
    assert sorted(r["n"] for r in decode(coded, "i", dictionary, "n").collect()) == ["a", "b", "b"]
    late = spark.createDataFrame([("zz",)], "label string")
    with pytest.raises(Exception, match="not in the dictionary"):
        encode(late, "label", dictionary, "i").collect()
    assert encode(late, "label", dictionary, "i", unseen="null").first()["i"] is None


def test_scores_of_a_model_without_a_class(spark):
    df = spark.createDataFrame([([0.3, 0.7],)], "s array<double>")
    spread = spread_scores(F.col("s"), ["a", "c"], ["a", "b", "c"])
    assert df.select(spread.alias("x")).first()["x"] == [0.3, 0.0, 0.7]
