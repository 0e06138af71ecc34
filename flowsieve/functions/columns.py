"""Column access and numeric coercion."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters no decimal number holds, but which the JVM parser accepts in suffixed,
# hexadecimal and named numbers.
FOREIGN_LETTERS = "dDfFxX"

SENTINELS = (" ", "-")


def ref(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parsed(c: Column) -> Column:
    """Text to DOUBLE, NULL where it is no decimal number; NaN may remain."""
    foreign = reduce(or_, [c.contains(letter) for letter in FOREIGN_LETTERS])
    return F.when(~foreign, c.try_cast("double"))


def to_number(c: Column) -> Column:
    """Text to DOUBLE; text which is not a finite decimal number becomes NULL."""
    return finite(parsed(c))


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Coerce the named columns which are present to finite DOUBLE."""
    wanted = set(columns)

    def coerced(field: T.StructField) -> Column:
        c = ref(field.name)
        if field.name not in wanted:
            return c
        if isinstance(field.dataType, T.NumericType):
            return c.cast("double").alias(field.name)
        return parsed(c.cast("string")).alias(field.name)

    # Two projections: the parsed value is computed once and then tested.
    return infinite_to_null(df.select(*[coerced(f) for f in df.schema.fields]), wanted)


def infinite_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN and infinities of floating columns, all or the named ones, become NULL."""
    wanted = set(df.columns if columns is None else columns)
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite(ref(f.name)).alias(f.name)
            if f.name in wanted and isinstance(f.dataType, floating)
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def sentinels_to_null(
    df: DataFrame, tokens: Iterable[str] = SENTINELS, columns: Iterable[str] | None = None
) -> DataFrame:
    """String cells equal to one of ``tokens`` become NULL, in all or the named columns."""
    tokens = list(tokens)
    wanted = set(df.columns if columns is None else columns)
    return df.select(
        *[
            F.when(~ref(f.name).isin(tokens), ref(f.name)).alias(f.name)
            if f.name in wanted and isinstance(f.dataType, T.StringType)
            else ref(f.name)
            for f in df.schema.fields
        ]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, not_features: Iterable[str]) -> list[str]:
    """All columns but the labels and keys, in table order."""
    excluded = set(not_features)
    return [c for c in df.columns if c not in excluded]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns by exact name; absent names are ignored."""
    gone = set(names)
    return df.select(*[ref(c) for c in df.columns if c not in gone])


def normalise_name(name: str, keep_spaces: bool = False) -> str:
    clean = name.strip().lower()
    return clean if keep_spaces else clean.replace(" ", "_")


def normalise_header(df: DataFrame, keep_spaces: bool = False) -> DataFrame:
    return df.toDF(*[normalise_name(c, keep_spaces) for c in df.columns])


def rename_select(df: DataFrame, mapping: dict[str, str], strict: bool) -> DataFrame:
    """Keep and rename mapped columns.

    ``strict`` asks for all of them; otherwise absent ones are left out.
    """
    present = set(df.columns)
    chosen = [(a, b) for a, b in mapping.items() if strict or a in present]
    return df.select(*[ref(a).alias(b) for a, b in chosen])


def scale_units(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Multiply columns by fixed factors."""
    return df.select(
        *[
            (ref(c) * F.lit(float(factors[c]))).alias(c) if c in factors else ref(c)
            for c in df.columns
        ]
    )
