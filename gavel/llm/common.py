"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import shared_path

#: Fixed values of the word rule: white space is space and \t..\r.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_value(module) -> None:
    """Send a module's functions to Python workers by value, so that executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)


def worker_memory() -> dict:
    """A dict that lives as long as the Python worker: tasks of one worker share
    loaded models and memos. (Globals of code sent by value are made anew for
    every task.)"""
    import sys
    import types

    return sys.modules.setdefault("training_data_worker_memory", types.ModuleType("training_data_worker_memory")).__dict__


def release_memory() -> None:
    """Give the freed memory of a Python worker back to the system: workers are
    reused, and the next stage's tasks share the executor's limit with it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, and later reads survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more: all that came from them
    is written. Shuffle files of finished frames go as well."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release_shuffles(tables[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark's cleaner deletes the shuffle files of
    frames that are referred to no more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the built-in fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside space and \\t..\\r."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def id_crc(col: Column | str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def slices(batch, column: str, most_bytes: int):
    """Cut an Arrow batch into runs of rows whose texts hold about
    ``most_bytes`` (one row at least), so that working arrays stay bounded."""
    import numpy as np
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)) if len(col) else np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(col):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
