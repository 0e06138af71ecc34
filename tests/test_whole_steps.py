"""Steps that must reach what follows them, over all their rows."""

from dataclasses import replace

from flowsieve.operators.prep import FeaturePrep
from flowsieve.operators.classes import class_counts
from flowsieve.plans import experiments, prepare, queries


def test_the_loaded_scaler_is_used(spark, sf_dir, monkeypatch):
    """A scaler that was stored wrongly shows in the verdicts of the loaded models."""
    assert [r["differing"] for r in queries.model_persistence(spark, sf_dir).collect()] == [0, 0]
    given = FeaturePrep.load.__func__
    monkeypatch.setattr(FeaturePrep, "load", classmethod(lambda cls, *a: _moved(given(cls, *a))))
    found = queries.model_persistence(spark, sf_dir).collect()
    assert found and all(r["differing"] == r["n"] > 0 for r in found)


def _moved(prep):
    return replace(prep, center={c: v + 1.0 for c, v in prep.center.items()})


def test_unscaled_rows_scale_to_the_table(spark, tmp_path):
    rows = [("tcp", float(i), "a" if i % 2 else "b") for i in range(20)] + [(None, None, "a"), ("udp", 2.0, "b")] * 5
    clean = spark.createDataFrame(rows, "proto string, x double, label string")
    data = prepare.fit_and_scale(clean, "label", ["label"], categorical=["proto"])
    data.unscaled().save(str(tmp_path / "data"))
    again = prepare.load_prepared(spark, str(tmp_path / "data")).scaled()
    names = data.table.columns
    assert sorted(map(repr, again.table.select(names).collect())) == sorted(map(repr, data.table.select(names).collect()))


def test_boosted_smote_learns_from_every_training_row(spark, sf_dir, monkeypatch):
    """No class is reduced before the others are raised to the largest."""
    monkeypatch.setattr(experiments.training_base, "__defaults__", (None, None, 50))
    seen = []
    given = experiments.fit_boosted
    monkeypatch.setattr(experiments, "fit_boosted", lambda df, *a, **k: seen.append(df) or given(df, *a, **k, rounds=2, depth=3))
    assert queries.boosted_smote(spark, sf_dir).count() == 3
    largest = class_counts(queries._class_data(spark, sf_dir).train, "label").agg({"n": "max"}).first()[0]
    assert {r["n"] for r in class_counts(seen[0], "label").collect()} == {largest} and largest > 50
