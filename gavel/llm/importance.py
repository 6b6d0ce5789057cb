"""Target-distribution importance resampling with segment deduplication.

Features of a text are its words and pairs of neighbouring words, hashed to
buckets (CRC-32 of the feature). A bucket's gain is the log ratio of its share
in the target texts to that in the raw ones; a document's weight is the mean
gain of its features, and Gumbel noise from a hash of its id turns the highest
scores into a sample without replacement.

Line breaks never stand inside a word, so they cut a text into segments. Copied
lines are common, so lines are grouped by their whole content first: the buckets
of a distinct line are computed once, and count as often as the line occurs.
Pairs that reach across a line break belong to no line; they are read from the
documents and added separately. Both the totals and the weights come from these
two tables:

- ``lines``: key (MD5 of the line), n (occurrences), buckets;
- ``parts``: one row per document: its pairs across lines, and (key, n) of its lines.

Weights need the sum of gains of each line next to the documents that hold it.
Lines with more than a quarter of a partition's occurrences (so at most
4 * partitions of them) are broadcast with their sums; the rest is a join on the
key, in which no line is hot.

Defined cases: an empty table gives no rows; a null, empty or wordless text has
no features, weight 0 and is never drawn; without target texts all target counts
are 0; repeated rows are scored and drawn as rows of their own, those with equal
score and id in any order; a null id counts as the empty text in the hash and
comes after all ids in ties.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm import common, word_hash
from gavel.llm.common import by_value, staged, text_of
from gavel.llm.word_hash import _bytes_of, text_runs

by_value(sys.modules[__name__])
by_value(common)
by_value(word_hash)

BUCKETS = 10_000
LEAST_WORDS = 20
#: Words of more bytes go through zlib one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    """Remainders of the 256 bytes by the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _crc_on(state: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC registers ``state`` carried on over bytes first..last of ``b``, all
    words at once: one step a byte position, over the words that reach it."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    reg, at, size = state[order], first[order], size[order]
    n_long = int(np.searchsorted(-size, -LONG, side="left"))
    for i in range(n_long):
        reg[i] = zlib.crc32(b[at[i] : at[i] + size[i]].tobytes(), int(reg[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        upto = int(np.searchsorted(-size, -k, side="left"))
        part = reg[n_long:upto]
        reg[n_long:upto] = table[(part ^ b[at[n_long:upto] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    return out


def text_features(texts: pa.Array, buckets: int, across: bool):
    """(buckets of the features, offsets by text): words and pairs of each text,
    or with ``across`` only the pairs whose words stand in different lines."""
    b, off = _bytes_of(texts)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    b = low[b]
    solid = ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate([[False], solid[:-1]])[: len(b)] & ~edge[:-1]
    after = np.concatenate([solid[1:], [False]])[: len(b)] & ~edge[1:]
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    owner = np.searchsorted(off, first, side="right") - 1
    pair = np.flatnonzero(owner[1:] == owner[:-1])  # of word i and the next
    table, start = _crc_table(), np.uint32(0xFFFFFFFF)
    if across:
        line = np.searchsorted(np.flatnonzero(b == 10), first)
        pair = pair[line[pair] != line[pair + 1]]
        of_word = _crc_on(np.full(len(pair), start), b, first[pair], last[pair], table)
        own, at = owner[pair], of_word
    else:
        of_word = _crc_on(np.full(len(first), start), b, first, last, table)
        own, at = np.concatenate([owner, owner[pair]]), of_word[pair]
    at = table[(at ^ np.uint32(32)) & np.uint32(255)] ^ (at >> np.uint32(8))
    at = _crc_on(at, b, first[pair + 1], last[pair + 1], table)
    reg = at if across else np.concatenate([of_word, at])
    order = np.argsort(own, kind="stable")
    found = ((reg ^ start) % np.uint32(buckets)).astype(_kind(buckets))[order]
    return found, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]).astype(np.int64)


def _kind(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _blobs(values: np.ndarray, off: np.ndarray) -> pa.Array:
    at = (off * values.dtype.itemsize).astype(np.int32)  # of a bounded run of texts
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def line_table(texts: DataFrame, buckets: int) -> DataFrame:
    """key, n, buckets of the distinct lines of column ``text``."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line != ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    def hashed(batches):
        for batch in batches:
            for lo, run in text_runs(batch, "line"):
                part = batch.slice(lo, len(run))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _blobs(*text_features(run, buckets, False))], names=["key", "n", "buckets"])

    return lines.select(F.unhex(F.md5("line")).alias("key"), "n", "line").mapInArrow(hashed, "key binary, n long, buckets binary")


def part_table(docs: DataFrame, buckets: int) -> DataFrame:
    """uid, id, buckets (pairs across lines), lines (key, n) of the documents
    (columns id, text)."""
    def parted(batches):
        from collections import Counter
        from hashlib import md5

        kind = pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            for lo, run in text_runs(batch, "text"):
                part = batch.slice(lo, len(run))
                b, off = _bytes_of(run)
                held = [Counter(md5(x).digest() for x in b[s:e].tobytes().split(b"\n") if x) for s, e in zip(off[:-1], off[1:], strict=True)]
                lines = pa.array([[{"key": k, "n": n} for k, n in c.items()] for c in held], type=kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _blobs(*text_features(run, buckets, True)), lines], names=["uid", "id", "buckets", "lines"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    return rows.mapInArrow(parted, f"uid long, id {docs.schema['id'].dataType.simpleString()}, buckets binary, lines array<struct<key: binary, n: long>>")


def _totals(table: DataFrame, times: Column, buckets: int) -> DataFrame:
    """bucket, n: counts of a table's buckets, each row ``times`` as often; one
    row per bucket and task goes through the shuffle."""
    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            b, off = _bytes_of(batch.column(0))
            size = np.diff(off) // np.dtype(_kind(buckets)).itemsize
            values, times_of = b.view(_kind(buckets)), np.repeat(np.asarray(batch.column(1)), size)
            # whole numbers below 2**53 are exact in the doubles of bincount; batches are bounded, so are their sums
            total += np.bincount(values, weights=times_of, minlength=buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return table.select("buckets", times.alias("times")).mapInArrow(counted, "bucket long, n long")


def bucket_counts(lines: DataFrame, parts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all buckets: ``buckets`` numbers, whatever the input."""
    both = _totals(lines, F.col("n"), buckets).unionByName(_totals(parts, F.lit(1).cast("long"), buckets))
    total = np.zeros(buckets, dtype=np.int64)
    for row in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of each bucket."""
    from math import floor, log

    n_raw, n_target, k = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([floor(1000 * log((t + 1.0) * (n_raw + k) / ((s + 1.0) * (n_target + k)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _gain_sums(table: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep``, with features and gain (their sum) of a row's buckets."""
    def summed(batches):
        for batch in batches:
            b, off = _bytes_of(batch.column(0))
            size = np.dtype(_kind(len(gain))).itemsize
            upto = np.concatenate([[0], np.cumsum(gain[b.view(_kind(len(gain)))])])
            at = off // size
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(at)), pa.array(upto[at[1:]] - upto[at[:-1]])], names=[*keep, "features", "gain"])

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select("buckets", *keep).mapInArrow(summed, f"{kinds}, features long, gain long")


def weights(lines: DataFrame, parts: DataFrame, gain: np.ndarray) -> DataFrame:
    """uid, id, n_features, weight of every document."""
    n_parts = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_line = staged(_gain_sums(lines, gain, ["key", "n"]), "line-gains")
    limit = max(1, (of_line.agg(F.sum("n")).first()[0] or 0) // (4 * n_parts))
    hot = of_line.filter(F.col("n") > limit).select("key", F.col("features").alias("hot_features"), F.col("gain").alias("hot_gain"))
    held = parts.select("uid", F.inline("lines")).withColumnRenamed("n", "times")
    held = staged(held.join(F.broadcast(hot), "key", "left"), "lines-of-documents")  # at most 4 * n_parts hot lines
    known = held.filter("hot_gain IS NOT NULL").select("uid", (F.col("times") * F.col("hot_features")).alias("features"), (F.col("times") * F.col("hot_gain")).alias("gain"))
    rest = held.filter("hot_gain IS NULL").select("uid", "key", "times").join(of_line.filter(F.col("n") <= limit).select("key", "features", "gain"), "key")
    rest = rest.select("uid", (F.col("times") * F.col("features")).alias("features"), (F.col("times") * F.col("gain")).alias("gain"))
    own = _gain_sums(parts, gain, ["uid", "id"])
    none = F.lit(None).cast(parts.schema["id"].dataType).alias("id")
    rows = own.unionByName(known.select("uid", none, "features", "gain")).unionByName(rest.select("uid", none, "features", "gain"))
    total = rows.groupBy("uid").agg(F.max("id").alias("id"), F.sum("features").alias("n_features"), F.sum("gain").alias("gain"))
    mean = F.floor((F.col("gain") - F.pmod("gain", "n_features")) / F.col("n_features")).cast("long")
    return total.select("uid", "id", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long").alias("weight"))


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """id, n_features, weight, score, rank (null: not drawn) of every document."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    lines, parts = staged(line_table(texts, buckets), "lines"), staged(part_table(texts, buckets), "parts")
    wanted = target.select(F.lit(None).cast("long").alias("id"), text_of(target_col).alias("text"))
    counts = bucket_counts(staged(line_table(wanted, buckets), "target-lines"), staged(part_table(wanted, buckets), "target-parts"), buckets)
    rows = weights(lines, parts, gains(bucket_counts(lines, parts, buckets), counts))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a text of w words has w + (w - 1) features
    may = F.col("n_features") >= 2 * least_words - 1
    order = [(~may).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid")]
    rows = staged(rows.withColumn("may", may).repartitionByRange(n_parts, (~F.col("may")).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid")).withColumn("pid", F.spark_partition_id()), "scored")
    sizes = rows.groupBy("pid").agg(F.count_if("may").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = sizes.select("pid", before.alias("before"))
    draw = percent * (sizes.agg(F.sum("n")).first()[0] or 0) // 100
    place = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    ranked = rows.join(F.broadcast(offsets), "pid").withColumn("place", place)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("may") & (F.col("place") <= draw), F.col("place")).cast("long").alias("rank"))
