"""Headline timings on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowsieve.functions.labels import BENIGN  # noqa: E402
from flowsieve.operators import balance  # noqa: E402
from flowsieve.operators.cascade import apply_cascade  # noqa: E402
from flowsieve.operators.isolation import SWEEP, IsolationForest  # noqa: E402
from flowsieve.operators.models import fit_boosted, fit_forest, fit_logistic  # noqa: E402
from flowsieve.operators.smote import smote  # noqa: E402
from flowsieve.plans import prepare  # noqa: E402
from flowsieve.plans import queries as catalog  # noqa: E402
from flowsieve.session import stage  # noqa: E402
from flowsieve.sources import flows_csv  # noqa: E402
from flowsieve.sources.standins import LINEITEM_KEY  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))

LIGHT = (
    "parquet_scan", "class_counts", "label_normalise", "numeric_coerce", "stratified_split_counts",
    "train_quartiles", "robust_scale", "one_hot", "balanced_weights", "smote_exact",
    "average_precision_per_class", "classification_report", "held_out_detection",
    "cascade_combine", "anomaly_threshold_sweep",
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str, work, count: int | None = None):
        started = time.monotonic()
        result = work()
        seconds[name] = round(time.monotonic() - started, 3)
        if count:
            rows[name] = count
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
        return result

    run(spark.range(1000).groupBy(F.col("id") % 7).count())  # start the workers
    for name in LIGHT:
        timed(name, lambda: run(catalog.QUERIES[name](spark, SF_DIR)))

    cic, unsw = catalog._write_cic(spark, SF_DIR), catalog._write_unsw(spark, SF_DIR)
    cic_raw = flows_csv.scan_headered(spark, cic, text=["label"])
    unsw_raw = flows_csv.scan_headerless(spark, unsw, text=prepare.UNSW_TEXT)
    n_raw = unsw_raw.count()
    timed("prepare_cic_binary", lambda: run(prepare.cic_binary(cic_raw).table), n_raw)
    timed("prepare_cic_multiclass", lambda: run(prepare.cic_multiclass(cic_raw).table), n_raw)
    timed("prepare_unsw", lambda: run(prepare.unsw(unsw_raw).table), n_raw)

    data = timed("prepare_flows", lambda: catalog._class_data(spark, SF_DIR))
    table = stage(data.table.withColumn("is_attack", (F.col("label") != BENIGN).cast("int")), "bench")
    data = type(data)(table, data.features, data.prep)
    train, test = data.train, data.test
    n_train, n_test = train.count(), test.count()

    logistic = fit_logistic(train, "is_attack", data.features)
    seconds["logistic_fit"], rows["logistic_fit"] = round(logistic.fit_seconds, 3), n_train
    forest = fit_forest(train, "is_attack", data.features)
    seconds["forest_fit"], rows["forest_fit"] = round(forest.fit_seconds, 3), n_train
    timed("forest_score", lambda: run(forest.predict(test)), n_test)
    base = stage(balance.downsample(train, "label", key=LINEITEM_KEY), "bench-base")
    boosted = fit_boosted(base, "label", data.features, balanced=True)
    seconds["boosted_weighted_fit"], rows["boosted_weighted_fit"] = round(boosted.fit_seconds, 3), base.count()
    raised = timed("smote", lambda: stage(smote(base, "label", data.features, LINEITEM_KEY), "bench-raised"))
    rows["smote"] = raised.count()
    on_smote = fit_boosted(raised, "label", data.features, balanced=False)
    seconds["boosted_smote_fit"], rows["boosted_smote_fit"] = round(on_smote.fit_seconds, 3), rows["smote"]
    detector = timed("isolation_fit", lambda: IsolationForest.fit(train, data.features, LINEITEM_KEY), n_train)
    offsets = timed("isolation_offsets", lambda: detector.offsets(train, SWEEP), n_train)
    detector = detector.with_offset(offsets[0.15])
    timed("isolation_score", lambda: run(detector.predict(test)), n_test)
    timed("cascade_score", lambda: run(apply_cascade(test, detector, boosted, BENIGN)), n_test)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": rows,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
