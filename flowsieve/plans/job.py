"""The whole job: raw files to tables, models, metrics and a summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowsieve.functions.labels import BENIGN, NORMAL
from flowsieve.operators.metrics import METRIC_SCHEMA, summary, union_all
from flowsieve.plans import experiments, prepare
from flowsieve.sources.flows_csv import scan_headered, scan_headerless
from flowsieve.sources.tables import read_json, write_json

SUMMARY = (
    "accuracy", "precision", "recall", "f1", "far", "auc_pr", "fit_seconds", "score_seconds",
    "flagged", "bypassed",
)


@dataclass(frozen=True)
class Settings:
    """Model sizes; empty dictionaries stand for the full training set-up."""

    logistic: dict = field(default_factory=dict)
    forest: dict = field(default_factory=dict)
    boost: dict = field(default_factory=dict)
    trees: int = experiments.TREES
    base_rows: int = experiments.BASE_ROWS
    null_label: str = "attack"


def bronze(raw: DataFrame, path: str) -> DataFrame:
    """Raw text cells as parquet: the files are parsed once for all tables."""
    raw.write.mode("overwrite").parquet(path)
    return raw.sparkSession.read.parquet(path)


def keep(outcome: experiments.Outcome, spark: SparkSession, path: str, name: str) -> DataFrame:
    """Store the models and the metric rows of one experiment."""
    for model, fitted in outcome.models.items():
        fitted.save(spark, f"{path}/models/{name}-{model}")
    write_json(outcome.rows, f"{path}/metrics/{name}")
    return read_json(spark, f"{path}/metrics/{name}", METRIC_SCHEMA)


def run_dataset(
    spark: SparkSession,
    binary: prepare.Prepared,
    classes: prepare.Prepared,
    binary_label: str,
    class_label: str,
    benign: str,
    majority: str | None,
    out: str,
    name: str,
    settings: Settings,
) -> list[DataFrame]:
    """Binary baselines, multiclass models, detector sweep and cascade of one dataset."""
    rows = [
        keep(
            experiments.binary_baselines(
                binary, binary_label, f"{name} binary", settings.logistic, settings.forest
            ),
            spark, out, f"{name}-binary",
        )
    ]
    multi = experiments.multiclass(
        classes, class_label, f"{name} multiclass", benign, majority,
        base_rows=settings.base_rows, boost=settings.boost,
    )
    rows.append(keep(multi, spark, out, f"{name}-multiclass"))
    sweep = experiments.anomaly_sweep(
        classes, class_label, f"{name} anomaly", benign, trees=settings.trees
    )
    rows.append(keep(sweep, spark, out, f"{name}-anomaly"))
    triage = experiments.cascade(
        classes, class_label, f"{name} cascade", sweep.models["isolation"], multi.models["smote"], benign
    )
    rows.append(keep(triage, spark, out, f"{name}-cascade"))
    return rows


def run_all(
    spark: SparkSession,
    out: str,
    cic_glob: str | None = None,
    unsw_paths: str | list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Run every experiment whose inputs are given; returns and stores the summary."""
    rows: list[DataFrame] = []
    shared: dict[str, DataFrame] = {}
    if cic_glob:
        raw = bronze(scan_headered(spark, cic_glob, text=["label"]), f"{out}/tables/cic-raw")
        binary = prepare.cic_binary(raw, settings.null_label).save(f"{out}/tables/cic-binary")
        classes = prepare.cic_multiclass(raw).save(f"{out}/tables/cic-classes")
        rows += run_dataset(
            spark, binary, _without(classes, "multiclass_label"), "is_attack", "label", BENIGN, None,
            out, "cic", settings,
        )
        shared["cic"] = prepare.cic_shared(raw)
    if unsw_paths:
        raw = bronze(scan_headerless(spark, unsw_paths, text=prepare.UNSW_TEXT), f"{out}/tables/unsw-raw")
        flows = prepare.unsw(raw).save(f"{out}/tables/unsw")
        rows += run_dataset(
            spark, flows, _without(flows, "label"), "label", "multiclass_label", NORMAL, NORMAL,
            out, "unsw", settings,
        )
        shared["unsw"] = prepare.unsw_shared(raw)
    for name, table in shared.items():
        table.write.mode("overwrite").parquet(f"{out}/tables/{name}-shared")
        shared[name] = spark.read.parquet(f"{out}/tables/{name}-shared")
    if len(shared) == 2:
        for home, away in (("cic", "unsw"), ("unsw", "cic")):
            moved = experiments.transfer(
                shared[home], shared[away], f"{home} to {away}", forest=settings.forest
            )
            rows.append(keep(moved, spark, out, f"{home}-to-{away}"))
    result = summary(union_all(rows), SUMMARY)
    write_json(result, f"{out}/summary")
    return result


def _without(data: prepare.Prepared, column: str) -> prepare.Prepared:
    return prepare.Prepared(data.table.drop(column), data.features, data.prep, data.one_hot)
