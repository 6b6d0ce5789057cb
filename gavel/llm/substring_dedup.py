"""Substring deduplication by paragraph MinHash banding.

Units of text that may repeat:

- *paragraphs*: lines of at least ``WINDOW`` words. Their distinct 5-word
  shingles are signed with minhashes and banded (``BANDS`` x ``ROWS``: a
  similarity of 0.75 shares a band with probability 0.998); colliding paragraphs
  are joined and their exact Jaccard similarity is verified;
- *anchored passages*: runs of ``WINDOW`` words that start at the smallest word
  hash of every ``REACH`` words. Two texts that share ``WINDOW + REACH - 1`` = 51
  words share such a passage wherever it stands within their lines, so repeats
  of over 50 words are always found, and none of under ``WINDOW`` words is. A
  changed word leaves less than 0.75 of so short a passage, so equal words are
  what links passages.

Units with equal content form a class; classes link into components; a component
counts if it occurs in two documents. Its first document (smallest id) keeps it,
every other occurrence is a removal. Overlapping or adjacent units of one
document with the same fate merge into spans.

Hot passages combine map-side into one row per class before the shuffle; joins
of occurrences to classes split skewed classes; nothing is paired within a
class.

Defined cases: null text counts as empty; texts without ``WINDOW`` words in a
row have no units; a repeat within one document only does not count; rows with
equal id are one document for that rule, and their spans are listed each.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm import common, near_dedup, word_hash
from gavel.llm.common import by_value, discard, release_shuffles, staged, text_of
from gavel.llm.near_dedup import ODD, connect, set_names, shingle_sets
from gavel.llm.word_hash import blend, hash_words, text_runs

by_value(sys.modules[__name__])
by_value(common)
by_value(near_dedup)
by_value(word_hash)

WINDOW, REACH = 36, 16
BANDS, ROWS = 16, 4
CHUNK = 1 << 18


def windows(word, at):
    """Start (index into ``word``) of each anchored passage, its name (64 bits
    and 32 more to check them), and its document, for documents given by
    offsets."""
    n = len(word) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none.astype(np.int32), none
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    mixed = blend(word)
    power = np.ones(len(word) + 1, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(len(word), ODD[0], dtype=np.uint64))
    inverse = np.uint64(pow(int(ODD[0]), -1, 1 << 64))
    back = np.ones(n, dtype=np.uint64)
    back[1:] = np.cumprod(np.full(n - 1, inverse, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)])
    name = blend((total[WINDOW:] - total[:-WINDOW]) * back)
    plain = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(blend(word ^ ODD[1]) * power[:-1] * power[:-1], dtype=np.uint64)])
    check = (blend((plain[WINDOW:] - plain[:-WINDOW]) * back * back) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    fits = doc[:n] == doc[WINDOW - 1 :]
    # the smallest name of every REACH consecutive starts within a document
    order = np.where(fits, name, np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = np.zeros(n, dtype=bool)
    if n >= REACH:
        view = np.lib.stride_tricks.sliding_window_view(order, REACH)
        whole = doc[: len(view)] == doc[REACH + WINDOW - 2 :]
        best = np.flatnonzero(whole)
        for lo in range(0, len(best), CHUNK):
            here = best[lo : lo + CHUNK]
            chosen[here + view[here].argmin(axis=1)] = True
    # documents with fewer than REACH starts: their smallest name
    size = np.diff(at) - WINDOW + 1
    for d in np.flatnonzero((size > 0) & (size < REACH)):
        chosen[at[d] + int(order[at[d] : at[d] + size[d]].argmin())] = True
    start = np.flatnonzero(chosen & fits)
    return start, name[start], check[start], doc[start]


def _line_units(word, at, line):
    """(first word, end) of each line of at least WINDOW words."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not len(word):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), doc
    head = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    end = np.append(head[1:], len(word))
    long = end - head >= WINDOW
    return head[long], end[long], doc[head[long]]


def _line_sets(word, head, end):
    lens = end - head
    at = np.concatenate([[0], np.cumsum(lens)])
    index = np.repeat(head - at[:-1], lens) + np.arange(at[-1])
    return shingle_sets(word[index], at)


def _minhashes(h, cut):
    out = np.empty((len(cut) - 1, BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        x = blend(h * ODD[k % 5] + np.uint64(k * 2 + 1)) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, cut[:-1])
    return out


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name, check, first word of every anchored passage."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for lo, texts in text_runs(batch, "t"):
                word, at, _line = hash_words(texts)
                start, name, check, doc = windows(word, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array(name.view(np.int64)), pa.array(check), pa.array((start - at[doc]).astype(np.int32))], names=["id", "name", "check", "first"])

    return src.mapInArrow(run, "id long, name long, check int, first int")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, name (16 bytes, of the shingle set), first word, number of words and
    minhashes of every paragraph."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for lo, texts in text_runs(batch, "t"):
                word, at, line = hash_words(texts, lines=True)
                head, end, doc = _line_units(word, at, line)
                if not len(head):
                    continue
                h, cut = _line_sets(word, head, end)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array([x.tobytes() for x in set_names(h, cut)], pa.binary()), pa.array((head - at[doc]).astype(np.int32)), pa.array((end - head).astype(np.int32)), pa.array([x.tobytes() for x in _minhashes(h, cut)], pa.binary())], names=["id", "name", "first", "words", "sig"])

    return src.mapInArrow(run, "id long, name binary, first int, words int, sig binary")


def _paragraph_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    src = src.join(wanted.select("rep").distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select(text_of("t").alias("t"))

    def run(batches):
        for batch in batches:
            for _lo, texts in text_runs(batch, "t"):
                word, at, line = hash_words(texts, lines=True)
                head, end, _doc = _line_units(word, at, line)
                if len(head):
                    h, cut = _line_sets(word, head, end)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in set_names(h, cut)], pa.binary()), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["name", "shingles"])

    return src.mapInArrow(run, "name binary, shingles binary").join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """id, first_word, words, removed, copies (occurrences of the span's most
    frequent unit), kept_id (the document that keeps it): spans of passages and
    paragraphs that repeat across documents."""
    # anchored passages: classes of equal words in two documents or more
    runs = units(docs, id_col, text_col)
    # by name alone first: few of the passages reach the second step
    named = staged(runs.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("name"), "passage-names")
    release_shuffles(docs.sparkSession)
    some = staged(runs.join(named, "name", "left_semi"), "passages")
    discard(named)
    twice = some.groupBy("name", "check").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("copies")).filter("lo != hi").drop("hi")
    at_windows = some.join(twice, ["name", "check"]).select("id", "first", F.lit(WINDOW).alias("words"), "lo", "copies")
    # paragraphs: classes of equal shingle sets, linked by similarity
    signed = staged(paragraphs(docs, id_col, text_col), "signed-lines")
    lines = staged(signed.drop("sig"), "lines")
    classes = lines.groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes, "paragraphs")
    sigs = signed.select("name", "id", "sig").join(classes.select("name", F.col("lo").alias("rep")), "name").filter(F.col("id").eqNullSafe(F.col("rep")))
    sigs = staged(sigs.select("name", "rep", "sig").dropDuplicates(["name"]), "paragraph-signatures")
    discard(signed)
    comp = connect(sigs, lambda wanted: _paragraph_sets(docs, wanted, id_col, text_col), percent, BANDS, ROWS)
    named = classes.join(comp, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    groups = named.groupBy("comp").agg(F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), F.sum("copies").alias("copies")).filter("first_id != last_id")
    groups = staged(named.select("name", "comp").join(groups, "comp").select("name", F.col("first_id").alias("lo"), "copies"), "paragraph-groups")
    at_lines = lines.select("id", "name", "first", "words").join(groups, "name").select("id", "first", "words", "lo", "copies")
    found = at_windows.union(at_lines).withColumn("removed", ~F.col("id").eqNullSafe(F.col("lo")))
    return spans(found).withColumnRenamed("id", id_col)


def spans(found: DataFrame) -> DataFrame:
    """Merge overlapping or adjacent units of one document and fate."""
    order = Window.partitionBy("id", "removed").orderBy("first", "words")  # the units of one document
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("first") > F.max(F.col("first") + F.col("words")).over(before), F.lit(True))
    found = found.distinct().withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.groupBy("id", "removed", "run").agg(
        F.min("first").alias("first_word"), (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("words"),
        F.max("copies").alias("copies"), F.min("lo").alias("kept_id"),
    ).select("id", "first_word", "words", "removed", "copies", "kept_id")
