"""The whole job on files written from the test tables, and triage of a stream."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators.isolation import IsolationForest
from flowsieve.operators.models import fit_logistic
from flowsieve.plans import prepare
from flowsieve.plans.job import Settings, run_all
from flowsieve.sources import flows_csv, standins
from flowsieve.sources.standins import LINEITEM_KEY
from flowsieve.streaming.triage import triage_stream

SMALL = Settings(
    logistic={"max_iter": 10}, forest={"trees": 3, "depth": 3}, boost={"rounds": 2, "depth": 2},
    trees=5, base_rows=500,
)
RAW = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": flows_csv.ENCODING}


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("flows")
    standins.cic_raw(spark, sf_dir).write.csv(f"{root}/cic", header=True, **RAW)
    standins.unsw_raw(spark, sf_dir).write.csv(f"{root}/unsw", header=False, **RAW)
    return root


def test_whole_job(spark, files, tmp_path):
    rows = run_all(spark, str(tmp_path), f"{files}/cic/*.csv", f"{files}/unsw", SMALL).collect()
    experiments = {r["experiment"] for r in rows}
    assert experiments >= {
        "cic binary", "cic multiclass", "cic anomaly", "cic cascade", "unsw binary",
        "unsw multiclass", "unsw anomaly", "unsw cascade", "cic to unsw", "unsw to cic",
    }
    scored = [r for r in rows if r["accuracy"] is not None]
    assert len(scored) == 2 * (2 + 2 + 3 + 1) + 4
    assert all(0 <= r["accuracy"] <= 1 and 0 <= r["far"] <= 1 for r in scored)
    stored = spark.read.json(f"{tmp_path}/summary")
    assert stored.count() == len(rows)
    again = prepare.load_prepared(spark, f"{tmp_path}/tables/cic-binary")
    assert again.train.count() + again.test.count() == spark.read.parquet(f"{tmp_path}/tables/cic-raw").count()


def test_missing_labels_can_be_dropped(spark, files):
    raw = flows_csv.scan_headered(spark, f"{files}/cic/*.csv", text=["label"])
    kept = prepare.cic_binary(raw, null_label="drop")
    everything = prepare.cic_binary(raw)
    missing = raw.filter("label IS NULL").count()
    assert missing > 0
    assert everything.table.count() - kept.table.count() == missing
    assert everything.table.filter("label = 'nan'").filter("is_attack = 0").isEmpty()


def test_split_statistics_come_from_training_rows(spark, sf_dir):
    data = prepare.fit_and_scale(
        standins.lineitem_shared(spark, sf_dir), "is_attack", ["is_attack"], LINEITEM_KEY
    )
    medians = data.train.agg(*[F.median(f).alias(f) for f in data.features]).first()
    assert all(abs(v) < 1e-9 for v in medians)
    assert data.features == list(prepare.SHARED_FEATURES)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    flows = standins.lineitem_shared(spark, sf_dir)
    data = prepare.fit_and_scale(flows, "is_attack", ["is_attack"], LINEITEM_KEY)
    detector = IsolationForest.fit(data.train, data.features, LINEITEM_KEY, trees=5).with_offset(-0.5)
    model = fit_logistic(data.train, "is_attack", data.features, max_iter=5)
    flows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(flows.schema).parquet(f"{tmp_path}/in")
    query = triage_stream(
        stream, data.prep, detector, model, 0, f"{tmp_path}/out", f"{tmp_path}/check"
    )
    query.awaitTermination(120)
    from flowsieve.operators.cascade import apply_cascade

    batch = apply_cascade(data.prep.transform(flows), detector, model, 0).select(*LINEITEM_KEY, "flagged", "prediction")
    got = spark.read.parquet(f"{tmp_path}/out").select(*LINEITEM_KEY, "flagged", "prediction")
    assert got.count() == flows.count()
    assert got.exceptAll(batch).isEmpty()
