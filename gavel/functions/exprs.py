"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric in the profile sense: booleans are not numbers here."""
    return isinstance(dt, NUMERIC_TYPES)


def is_flat(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def profileable(df: DataFrame) -> list[T.StructField]:
    """Flat columns only; nested columns are refused by the profile."""
    return [f for f in df.schema.fields if is_flat(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in profileable(df) if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in profileable(df) if not is_numeric(f.dataType)]


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def col(name: str) -> Column:
    """Column by exact name (names may hold '-', spaces or dots)."""
    return F.col(f"`{name}`")


def as_text(name: str, dt: T.DataType) -> Column:
    """Category text of a value: booleans print as True/False (the way the
    reported category keys read), everything else as its string cast."""
    c = col(name)
    if isinstance(dt, T.BooleanType):
        return F.when(c.isNull(), F.lit(None).cast("string")).when(c, "True").otherwise("False")
    return c.cast("string")


def nan_to_null(name: str, dt: T.DataType) -> Column:
    """NaN is a value in Spark but 'missing' for the governed data model."""
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c, F.lit(None).cast(dt)).alias(name)
    return c.alias(name)


def normalise_nan(df: DataFrame) -> DataFrame:
    """Ingest rule: NaN -> NULL in float columns (one projection, no pass)."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    return df.select(*[nan_to_null(f.name, f.dataType) for f in df.schema.fields])


def pct(numer: Column, denom: Column, dp: int | None = None) -> Column:
    """100 * numer / denom; NULL on a zero denominator (empty table)."""
    v = F.try_divide(numer.cast("double") * F.lit(100.0), denom.cast("double"))
    return F.round(v, dp) if dp is not None else v


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    needles = list(needles)
    if not needles:
        return F.lit(False)
    out = None
    for k in needles:
        e = F.contains(text, F.lit(k))
        out = e if out is None else (out | e)
    return out
