"""Sources and sinks: CSV/Parquet tables (SRC-1/2), stage tables per run
(SRC-3), fitted models (SRC-4) and previews (SRC-7).

Stage tables and models live under the shared folder the session names
(``spark.checkpoint.dir``), never under a machine-local temp dir.
"""

from __future__ import annotations

import os
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.exprs import col, normalise_nan
from gavel.sources import csv_records

SUPPORTED = (".csv", ".parquet")


# Texts that read as missing in a CSV file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-1: CSV with header or Parquet; other extensions are refused. NaN is
    normalised to NULL.

    CSV follows the usual quoting rules (a doubled quote inside quotes; line
    breaks inside quotes with ``multi_line``, by ``csv_records``: many tasks a
    file).
    The missing-value texts read as NULL, a row with the wrong number of fields
    fails the read, and types are inferred over all remaining values: boolean,
    int, bigint, double, else string."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file type {ext or '(none)'}: only CSV and Parquet are read")
    if ext == ".parquet":
        return normalise_nan(spark.read.parquet(path))
    raw = csv_records.read(spark, path) if multi_line else spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", quote='"', escape='"')
    return normalise_nan(_with_types(_without_markers(raw, MISSING_TEXTS)))


def _without_markers(df: DataFrame, markers) -> DataFrame:
    return df.select(*[F.when(F.trim(col(c)).isin(*markers), None).otherwise(col(c)).alias(c) for c in df.columns])


# A failed try_cast is a caught exception, far dearer than the scan, so only texts
# of a number's form are cast.
_WHOLE = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"
_NUMBER = r"(?i)^[\x00-\x20]*[+-]?(nan|inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[fd]?|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?)[\x00-\x20]*$"


def _kind(v):
    """Place in KINDS of the narrowest type that a text casts to; a text that
    casts to int casts to bigint and, delete characters aside, to double."""
    whole = F.when(v.rlike(_WHOLE), v.try_cast("bigint"))
    return (
        F.when(v.isNull(), None).when(whole.between(-(1 << 31), (1 << 31) - 1), 1).when(whole.isNotNull(), 2)
        .when(F.lower(v).isin("true", "false"), 0).when(F.when(v.rlike(_NUMBER), v.try_cast("double")).isNotNull(), 3).otherwise(4)
    )


#: Types that are inferred, the last for all other texts.
KINDS = ("boolean", "int", "bigint", "double", None)


def _with_types(df: DataFrame) -> DataFrame:
    """Narrowest of boolean, int, bigint, double that every value of a column
    casts to (one single-row aggregate); string otherwise."""
    kinds = df.select(*[e for i, c in enumerate(df.columns) for e in (_kind(F.trim(col(c))).alias(f"k{i}"), col(c).contains("\x7F").alias(f"d{i}"))])
    row = kinds.agg(*[f(x).alias(f"{n}{i}") for i in range(len(df.columns)) for n, f, x in (("lo", F.min, f"k{i}"), ("hi", F.max, f"k{i}"), ("del", F.max, f"d{i}"))]).first()
    out = []
    for i, c in enumerate(df.columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        # a whole number beside a delete character casts to integers only
        mixed = (lo == 0 and hi != 0) or (hi == 3 and row[f"del{i}"])
        kind = None if hi is None or mixed else KINDS[hi]
        out.append(F.trim(col(c)).cast(kind).alias(c) if kind else col(c))
    return df.select(*out)


def read_csv_named(spark: SparkSession, path: str, schema: T.StructType | str, na: tuple[str, ...] = ("?",)) -> DataFrame:
    """SRC-2: header-less CSV with given names/types. The missing-value markers
    (also after the separator's blank) read as NULL; a row with the wrong number
    of fields, or a value that is not of its column's type, fails the read."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    raw = spark.read.csv(path, schema=texts, header=False, mode="FAILFAST", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = _without_markers(raw, na) if na else raw
    return raw.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stage_path(root: str, run_id: str, stage: str) -> str:
    """One folder per run and stage: runs may differ in schema, and an id is
    kept as the text it is."""
    return f"{root.rstrip('/')}/run-{quote(run_id, safe='')}/{stage}"


def save_stage(df: DataFrame, root: str, run_id: str, stage: str) -> None:
    """SRC-3: store a stage's output for one run (overwriting that run's only)."""
    df.write.mode("overwrite").parquet(stage_path(root, run_id, stage))


def load_stage(spark: SparkSession, root: str, run_id: str, stage: str) -> DataFrame:
    """Read one run's stage output back."""
    return spark.read.parquet(stage_path(root, run_id, stage))


def save_model(model, path: str) -> None:
    """SRC-4: persist a fitted Spark ML model."""
    model.write().overwrite().save(path)


def load_model(path: str, of: type):
    """Load a model saved by ``save_model``; ``of`` is its class."""
    return of.load(path)


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """SRC-7: the first n rows by a key (deterministic head)."""
    return df.orderBy(key).limit(n)
