"""Class dictionaries, counts and class-driven row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.session import Pinned


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class; a missing label is a group of its own."""
    return df.groupBy(ref(label)).agg(F.count(F.lit(1)).alias("n"))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """One row: the largest class and its size; the first name wins a tie."""
    return class_counts(df, label).orderBy(F.desc("n"), ref(label)).limit(1)


def class_names(df: DataFrame, label: str) -> list:
    """Sorted distinct non-null classes, on the driver."""
    rows = df.select(ref(label)).filter(ref(label).isNotNull()).distinct()
    return sorted(r[0] for r in rows.collect())


def class_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(class_name, class_idx): sorted names numbered from zero."""
    distinct = df.select(ref(label).alias("class_name")).distinct()
    order = Window.orderBy("class_name")
    return distinct.filter("class_name IS NOT NULL").withColumn(
        "class_idx", F.dense_rank().over(order) - 1
    )


def encode(
    df: DataFrame, label: str, dictionary: DataFrame, out: str, unseen: str = "error"
) -> DataFrame:
    """Add the class index. An unseen class is an error, or NULL with ``unseen='null'``."""
    side = Pinned(dictionary.select(F.col("class_name").alias("_n"), F.col("class_idx").alias(out)))
    joined = df.join(side.side, ref(label) == F.col("_n"), "left").drop("_n")
    if unseen == "null":
        return joined
    text = F.concat(F.lit("class not in the dictionary: "), F.coalesce(ref(label).cast("string"), F.lit("NULL")))
    checked = F.when(ref(out).isNull(), F.raise_error(text).cast("int")).otherwise(ref(out))
    return joined.withColumn(out, checked)


def decode(df: DataFrame, index: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Add the class name; an index the dictionary lacks stays as its own text."""
    side = Pinned(dictionary.select(F.col("class_idx").alias("_i"), F.col("class_name").alias(out)))
    joined = df.join(side.side, ref(index) == F.col("_i"), "left").drop("_i")
    return joined.withColumn(out, F.coalesce(ref(out), ref(index).cast("string")))


def class_position(dictionary: DataFrame, name: str) -> DataFrame:
    return dictionary.filter(F.col("class_name") == name).select("class_idx")


def dense_reindex(dictionary: DataFrame, kept: DataFrame) -> DataFrame:
    """(class_name, class_idx, dense_idx) of the kept classes, numbered without gaps."""
    side = Pinned(kept.select("class_name").distinct())
    order = Window.orderBy("class_idx")
    return dictionary.join(side.side, "class_name", "left_semi").withColumn(
        "dense_idx", F.dense_rank().over(order) - 1
    )


def binarize(df: DataFrame, label: str, names: list, out_class: str, out_flag: str) -> DataFrame:
    """One row per input row and class: does the row carry the class?"""
    listed = F.explode(F.array(*[F.lit(n) for n in names]))
    return df.withColumn(out_class, listed).withColumn(
        out_flag, F.coalesce(ref(label) == ref(out_class), F.lit(False)).cast("int")
    )


def spread_scores(
    scores: Column, model_classes: list, all_classes: list, missing: float = 0.0
) -> Column:
    """Scores in model class order, spread over all classes in their order.

    A class the model does not know gets ``missing``. Works inside the row.
    """
    place = {name: i for i, name in enumerate(model_classes)}
    return F.array(
        *[
            F.get(scores, place[name]) if name in place else F.lit(float(missing))
            for name in all_classes
        ]
    )


def long_scores(
    df: DataFrame, label: str, scores: str, all_classes: list, key: list[str] = ()
) -> DataFrame:
    """One row per input row and class: (key, class, hit, score)."""
    pairs = F.arrays_zip(
        F.array(*[F.lit(n) for n in all_classes]).alias("name"), ref(scores).alias("score")
    )
    hit = F.coalesce(ref(label) == F.col("_p.name"), F.lit(False)).cast("int")
    return df.select(*[ref(k) for k in key], ref(label), F.explode(pairs).alias("_p")).select(
        *[ref(k) for k in key],
        F.col("_p.name").alias("class"),
        hit.alias("hit"),
        F.col("_p.score").alias("score"),
    )


def partition_rows(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the mask holds, and all others."""
    inside = F.coalesce(mask, F.lit(False))
    return df.filter(inside), df.filter(~inside)


def keep_known(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Rows whose class the dictionary holds."""
    side = Pinned(dictionary.select(F.col("class_name").alias("_n"))).side
    return df.join(side, ref(label) == F.col("_n"), "left_semi")
