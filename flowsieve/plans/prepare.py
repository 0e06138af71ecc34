"""Raw flow tables to scaled, split feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import (
    coerce_numeric,
    drop_columns,
    feature_columns,
    ref,
    rename_select,
    scale_units,
    sentinels_to_null,
)
from flowsieve.functions.hashing import row_hash
from flowsieve.functions.labels import (
    NORMAL,
    canonical_attack,
    canonical_benign,
    filled_label,
    is_attack,
    is_missing_label,
    keep_allowed,
    label_text,
)
from flowsieve.operators.classes import class_dictionary, encode
from flowsieve.operators.prep import FeaturePrep, OneHot
from flowsieve.operators.selection import stored_order
from flowsieve.operators.split import TEST, TRAIN, stratified_split
from flowsieve.session import stage
from flowsieve.sources.tables import write_splits

# Fixed values of the two flow datasets.
CIC_LEAKY = (
    "flow_id", "source_ip", "destination_ip", "timestamp", "source_port", "destination_port",
)
UNSW_LEAKY = ("srcip", "sport", "dstip", "dsport", "Stime", "Ltime")
UNSW_CATEGORICAL = ("proto", "state", "service")
UNSW_TEXT = (*UNSW_CATEGORICAL, "attack_cat")
SHARED_FEATURES = (
    "duration", "src_packets", "dst_packets", "src_bytes", "dst_bytes",
    "src_mean_packet_sz", "dst_mean_packet_sz", "src_iat_mean", "dst_iat_mean",
)
CIC_SHARED = {
    "flow duration": "duration",
    "total fwd packets": "src_packets",
    "total backward packets": "dst_packets",
    "total length of fwd packets": "src_bytes",
    "total length of bwd packets": "dst_bytes",
    "fwd packet length mean": "src_mean_packet_sz",
    "bwd packet length mean": "dst_mean_packet_sz",
    "fwd iat mean": "src_iat_mean",
    "bwd iat mean": "dst_iat_mean",
    "label": "label",
}
UNSW_SHARED = {
    "dur": "duration",
    "Spkts": "src_packets",
    "Dpkts": "dst_packets",
    "sbytes": "src_bytes",
    "dbytes": "dst_bytes",
    "smeansz": "src_mean_packet_sz",
    "dmeansz": "dst_mean_packet_sz",
    "Sintpkt": "src_iat_mean",
    "Dintpkt": "dst_iat_mean",
    "Label": "is_attack",
}
# Seconds and milliseconds to microseconds.
UNSW_UNITS = {"duration": 1e6, "src_iat_mean": 1e3, "dst_iat_mean": 1e3}

ROW_ID, ORDER = "_row_id", "_order"


@dataclass(frozen=True)
class Prepared:
    """A split, scaled table and what was fitted on its training rows."""

    table: DataFrame
    features: list[str]
    prep: FeaturePrep
    one_hot: OneHot | None = None
    # The table with the stored hashes of its rows in ``ORDER``, and their seed and key.
    ordered: DataFrame | None = None
    hashed_by: tuple[int, tuple[str, ...]] | None = None
    # The split rows before encoding and scaling.
    clean: DataFrame | None = None

    @property
    def train(self) -> DataFrame:
        return self.table.filter(F.col("split") == TRAIN).drop("split")

    @property
    def test(self) -> DataFrame:
        return self.table.filter(F.col("split") == TEST).drop("split")

    def hashed_train(self, key: Sequence[str] | None, seed: int = 42) -> tuple[DataFrame, str | None]:
        """Training rows, and the column that stores ``row_hash(seed, key)`` where there is one."""
        if key is None or self.hashed_by != (seed, tuple(key)):
            return self.train, None
        return self.ordered.filter(F.col("split") == TRAIN).drop("split"), ORDER

    def unscaled(self) -> Prepared:
        """The same statistics beside the split rows which they have not been applied to."""
        return Prepared(self.clean, self.features, self.prep, self.one_hot)

    def scaled(self) -> Prepared:
        """The table of unscaled rows, encoded and scaled by the statistics held here."""
        table = self.table if self.one_hot is None else self.one_hot.transform(self.table)
        return Prepared(self.prep.transform(table), self.features, self.prep, self.one_hot)

    def save(self, path: str) -> Prepared:
        """Store table and statistics; the result reads the stored table."""
        spark = self.table.sparkSession
        write_splits(self.table, f"{path}/table")
        self.prep.save(spark, f"{path}/prep")
        (self.one_hot or OneHot({})).save(spark, f"{path}/one-hot")
        stored = spark.read.parquet(f"{path}/table")
        return Prepared(stored, self.features, self.prep, self.one_hot)


def load_prepared(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Prepared:
    prep = FeaturePrep.load(spark, f"{path}/prep")
    table = spark.read.parquet(f"{path}/table")
    one_hot = OneHot.load(spark, f"{path}/one-hot")
    return Prepared(table, list(features or prep.features), prep, one_hot if one_hot.categories else None)


def with_row_id(raw: DataFrame) -> DataFrame:
    """Identity of a raw row: the hash of all its cells, the same only for equal rows."""
    return raw.withColumn(ROW_ID, row_hash(0, raw.columns))


def fit_and_scale(
    clean: DataFrame,
    stratum: str,
    labels: Sequence[str],
    key: Sequence[str] | None = None,
    categorical: Sequence[str] = (),
    seed: int = 42,
    method: str = "exact",
) -> Prepared:
    """Split, then fit one-hot, medians and scaling on the training rows only.

    ``key`` identifies a row; otherwise ``_row_id`` or the whole row does. The
    clean table is written once with its hash order, so that no later pass
    parses or hashes again; split, imputation and scaling stay narrow
    expressions over it.
    """
    if key is not None:
        order = row_hash(seed, key)
    else:
        order = stored_order(seed, [ROW_ID] if ROW_ID in clean.columns else clean.columns)
    staged = stage(drop_columns(clean.withColumn(ORDER, order), [ROW_ID]), "clean")
    table = stratified_split(staged, stratum, seed=seed, order=ORDER)
    train = table.filter(F.col("split") == TRAIN).drop("split", ORDER)
    unscaled = table.drop(ORDER)

    one_hot = None
    if categorical:
        one_hot = OneHot.fit(train, categorical)
        train, table = one_hot.transform(train), one_hot.transform(table)
    features = feature_columns(train, [*labels, *(key or [])])
    prep = FeaturePrep.fit(train, features, method, one_hot.flags() if one_hot else None)
    ordered = prep.transform(table)
    if key is None:
        return Prepared(ordered.drop(ORDER), prep.features, prep, one_hot, clean=unscaled)
    return Prepared(ordered.drop(ORDER), prep.features, prep, one_hot, ordered, (seed, tuple(key)), unscaled)


def cic_binary(raw: DataFrame, null_label: str = "attack", **options) -> Prepared:
    """Headered flows with ``label`` and ``is_attack``; stratified on the latter.

    A missing label counts as an attack, or is left out with ``null_label='drop'``.
    """
    raw = with_row_id(raw)
    if null_label == "drop":
        raw = raw.filter(~is_missing_label(F.col("label")))
    labelled = drop_columns(raw, CIC_LEAKY).withColumn(
        "label", canonical_benign(label_text(F.col("label")))
    )
    clean = _numeric_but(labelled, ["label", ROW_ID])
    clean = clean.withColumn("is_attack", is_attack(F.col("label")))
    return fit_and_scale(clean, "is_attack", ["label", "is_attack"], **options)


def cic_multiclass(raw: DataFrame, **options) -> Prepared:
    """Headered flows of the official classes, with ``label`` and ``multiclass_label``."""
    labelled = drop_columns(with_row_id(raw), CIC_LEAKY).withColumn(
        "label", canonical_attack(label_text(F.col("label")))
    )
    official = keep_allowed(labelled, "label")
    clean = _numeric_but(official, ["label", ROW_ID])
    clean = encode(clean, "label", class_dictionary(official, "label"), "multiclass_label")
    return fit_and_scale(clean, "multiclass_label", ["label", "multiclass_label"], **options)


def unsw(raw: DataFrame, **options) -> Prepared:
    """Headerless flows with ``multiclass_label`` (text) and ``label`` (0 or 1)."""
    named = drop_columns(with_row_id(raw), UNSW_LEAKY).withColumn(
        "attack_cat", filled_label(F.col("attack_cat"), NORMAL)
    )
    # A sentinel in a numeric column is no number: only text columns need the test.
    text = sentinels_to_null(named, columns=UNSW_TEXT)
    clean = _numeric_but(text, [*UNSW_TEXT, ROW_ID])
    clean = clean.withColumns(
        {"multiclass_label": F.col("attack_cat"), "_binary": F.col("Label").cast("int")}
    )
    clean = drop_columns(clean, ["attack_cat", "Label"]).withColumnRenamed("_binary", "label")
    return fit_and_scale(
        clean, "multiclass_label", ["multiclass_label", "label"],
        categorical=UNSW_CATEGORICAL, **options,
    )


def cic_shared(raw: DataFrame) -> DataFrame:
    """Headered flows in the shared schema; a feature the files lack is left out.

    Takes column names with spaces or with underscores.
    """
    underscored = {a.replace(" ", "_"): b for a, b in CIC_SHARED.items()}
    mapped = rename_select(raw, CIC_SHARED | underscored, strict=False)
    flagged = mapped.withColumn(
        "is_attack", is_attack(canonical_benign(label_text(F.col("label"))))
    )
    return _numeric_but(flagged.drop("label"), ["is_attack"])


def unsw_shared(raw: DataFrame) -> DataFrame:
    """Headerless flows in the shared schema, in its units."""
    numbers = _numeric_but(rename_select(raw, UNSW_SHARED, strict=True), [])
    return scale_units(numbers, UNSW_UNITS).withColumn("is_attack", F.col("is_attack").cast("int"))


def _numeric_but(df: DataFrame, text: Sequence[str]) -> DataFrame:
    return coerce_numeric(df, feature_columns(df, text))


def shared_columns(df: DataFrame) -> list[str]:
    return [c for c in SHARED_FEATURES if c in df.columns]


def in_schema(df: DataFrame, features: Sequence[str], label: str = "is_attack") -> DataFrame:
    return df.select(*[ref(f) for f in features], ref(label))
