"""Per-key prefix scans that survive a hot key.

``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one task;
with one run holding a third of all events that task holds a third of the
data. Here the ordered sequence of each key is cut into chunks of
``chunk`` consecutive sequence numbers. Windows run inside (key, chunk) - at
most ``chunk`` rows - and a carry-in from the earlier chunks of the same key
comes from a window over the chunk summaries, one row per (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 16


def _chunked(df: DataFrame, seq: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(seq) / F.lit(chunk)).cast("long"))


def previous_value(df: DataFrame, key: str, seq: str, value: str, out: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row (by ``seq``) of the same
    key, NULL for the first row (a chunked ``lag``)."""
    d = _chunked(df, seq, chunk)
    w_in = Window.partitionBy(key, "__chunk").orderBy(seq)
    d = d.withColumn("__lag", F.lag(value).over(w_in)).withColumn("__first", F.row_number().over(w_in) == 1)
    summ = d.groupBy(key, "__chunk").agg(F.max_by(value, F.col(seq)).alias("__chunk_last"))
    w_c = Window.partitionBy(key).orderBy("__chunk")
    carry = summ.select(key, "__chunk", F.lag("__chunk_last").over(w_c).alias("__carry"))
    res = d.join(carry, [key, "__chunk"], "left")
    res = res.withColumn(out, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag")))
    return res.drop("__chunk", "__lag", "__first", "__carry")


def prefix_scan(
    df: DataFrame,
    key: str,
    seq: str,
    sums: dict[str, Column] | None = None,
    lasts_before: dict[str, Column] | None = None,
    chunk: int = DEFAULT_CHUNK,
) -> DataFrame:
    """Several per-key prefix facts in one chunked pass: ``sums`` are
    inclusive running sums, ``lasts_before`` the last non-null value of an
    earlier row. One window inside (key, chunk), one aggregate of chunk
    summaries, one window over the summaries, one join back."""
    sums, lasts = sums or {}, lasts_before or {}
    d = _chunked(df, seq, chunk)
    for i, (o, v) in enumerate(sums.items()):
        d = d.withColumn(f"__s{i}", v.cast("long"))
    for i, (o, v) in enumerate(lasts.items()):
        d = d.withColumn(f"__l{i}", v)
    w_incl = Window.partitionBy(key, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_prev = Window.partitionBy(key, "__chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        "*",
        *[F.sum(f"__s{i}").over(w_incl).alias(f"__ls{i}") for i in range(len(sums))],
        *[F.last(f"__l{i}", ignorenulls=True).over(w_prev).alias(f"__ll{i}") for i in range(len(lasts))],
    )
    summ = d.groupBy(key, "__chunk").agg(
        *[F.sum(f"__s{i}").alias(f"__cs{i}") for i in range(len(sums))],
        *[F.max_by(f"__l{i}", F.when(F.col(f"__l{i}").isNotNull(), F.col(seq))).alias(f"__cl{i}") for i in range(len(lasts))],
    )
    w_c = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(
        key,
        "__chunk",
        *[F.coalesce(F.sum(f"__cs{i}").over(w_c), F.lit(0)).alias(f"__ks{i}") for i in range(len(sums))],
        *[F.last(f"__cl{i}", ignorenulls=True).over(w_c).alias(f"__kl{i}") for i in range(len(lasts))],
    )
    res = d.join(carry, [key, "__chunk"], "left")
    outs = [(F.col(f"__ls{i}") + F.col(f"__ks{i}")).cast("long").alias(o) for i, o in enumerate(sums)]
    outs += [F.coalesce(F.col(f"__ll{i}"), F.col(f"__kl{i}")).alias(o) for i, o in enumerate(lasts)]
    keep = [c for c in df.columns]
    return res.select(*keep, *outs)
