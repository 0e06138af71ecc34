"""The threshold of op5 comes from every labelled document."""

import numpy as np
import pandas as pd
import pytest

from flowsieve.llm import quality_rules


@pytest.mark.parametrize("seed", range(3))
def test_calibration_equals_plain_threshold(spark, monkeypatch, seed):
    monkeypatch.setattr(quality_rules, "RANGE_ROWS", 40)  # several ranges
    rng = np.random.default_rng(seed)
    good = rng.random(900) < 0.7
    scores = np.round(rng.normal(np.where(good, 0.4, 0.6), 0.1), 2 if seed else 6)
    known = spark.createDataFrame(pd.DataFrame({"score": scores, "good": good})).repartition(5)
    assert quality_rules.calibrated(known) == pytest.approx(quality_rules._threshold(scores, good), abs=1e-12)
    assert quality_rules.calibrated(known.where("good")) == quality_rules.calibrated(known.where("false")) == 1.0


def test_all_labels_reach_the_threshold(spark, monkeypatch):
    """More labelled documents than a draw would take: each one counts."""
    words = ["alpha", "beta", "gamma", "delta", "!!!!", "|||", "12345", "OMEGA"]
    rng = np.random.default_rng(7)
    docs = pd.DataFrame({"doc_id": range(300), "text": [" ".join(rng.choice(words[: 4 + i % 5], 80)) + f" x{i}" for i in range(300)]})
    labels = pd.DataFrame({"doc_id": range(300), "quality": [int(i % 5 < 3) for i in range(300)]})
    monkeypatch.setattr(quality_rules, "LABELLED_ROWS", 10)
    seen = []
    plain = quality_rules.calibrated
    monkeypatch.setattr(quality_rules, "calibrated", lambda known: seen.append(known.count()) or plain(known))
    out = quality_rules.judge(spark.createDataFrame(docs), spark.createDataFrame(labels)).toPandas()
    assert seen == [int((~out["base_failed"]).sum())] and seen[0] > 100
