"""Exact deduplication by a content sort (DataFrame operations only).

Texts are normalised (A-Z lower-cased, null counts as empty) and range
partitioned by Spark's sampled splitters on their first ``PREFIX`` characters,
then on a hash (so texts with a common start still divide, and a splitter has a
bounded size); an external sort puts equal texts next to each other, and a
window over the sorted run compares whole neighbouring texts.

A text whose copies hold more than a quarter of a partition's bytes is *hot*.
There are at most ``4 * partitions`` such texts, because their bytes are counted
(map-side combined, 8-byte keys). Their copies get a salt from the id, so they
range partition into several tasks; the pieces (at most ``8 * partitions``) are
merged afterwards.

Defined cases: an empty table gives no rows; null ids sort below all ids; of
repeated rows with equal id and text exactly one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import ascii_lower, staged, text_of


#: Characters of a text that a splitter holds.
PREFIX = 64


def _hot_texts(docs: DataFrame, norm, parts: int):
    """(hash, salts) of texts above a quarter of a partition; at most 4 * parts rows."""
    sizes = staged(docs.select(F.xxhash64(norm).alias("h"), (F.octet_length(norm) + 16).cast("long").alias("b")).groupBy("h").agg(F.sum("b").alias("b")), "text-sizes")
    total = sizes.agg(F.sum("b")).first()[0] or 0
    limit = max(1, total // (4 * parts))
    return sizes.filter(F.col("b") > limit).select("h", F.ceil(F.col("b") / F.lit(limit)).cast("long").alias("salts"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id (largest id among equal texts),
    group_size, kept, text_sha256. With ``carry`` the input row comes along as
    the struct ``row`` (so no input column can clash with the results)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    norm = ascii_lower(text_of(text_col))
    hot = _hot_texts(docs, norm, parts)
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *([row] if carry else []))
    # the hot list has at most 4 * parts rows of 16 bytes
    rows = rows.withColumn("h", F.xxhash64("norm")).join(F.broadcast(hot), "h", "left")
    rows = rows.withColumn("salt", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.col("salts")))).drop("salts")
    rows = rows.withColumn("start", F.left("norm", F.lit(PREFIX)))
    by_text = Window.partitionBy("start", "h", "salt", "norm").orderBy(F.col("id").desc_nulls_last())
    whole = by_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = rows.repartitionByRange(parts, "start", "h", "salt").select(
        "id", "salt", *(["row"] if carry else []),
        F.first("id").over(whole).alias("piece_keep"),
        F.count(F.lit(1)).over(whole).alias("piece_size"),
        F.row_number().over(by_text).alias("nth"),
        F.sha2("norm", 256).alias("sha"),
    )
    found = staged(found, "sorted-texts")
    merged = found.filter((F.col("salt") >= 0) & (F.col("nth") == 1)).groupBy("sha").agg(F.max("piece_keep").alias("all_keep"), F.sum("piece_size").alias("all_size"))
    out = found.join(F.broadcast(merged), "sha", "left")
    keep = F.when(F.col("all_size").isNull(), F.col("piece_keep")).otherwise(F.col("all_keep"))
    # a hot text whose ids are all null lies in one piece, as the salt comes from the id
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("all_size", "piece_size").alias("group_size"),
        ((F.col("nth") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns."""
    kept = mark(docs, id_col, text_col, carry=True).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
