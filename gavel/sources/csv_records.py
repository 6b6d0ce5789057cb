"""CSV records with line breaks inside quotes, read by many tasks.

A line either starts inside quotes or it does not; which one depends on all lines
before it. Each line is therefore reduced to what it makes of either case: it
keeps the state, turns it over, or ends in one state whatever it started in.
These effects combine: one scan adds them up by block (the part of a file that one
read takes), a window over the blocks of a file gives the state before each, and
a second scan walks every block from its state. The table of blocks is written, so
that its size decides how it is joined. Records within a block go on without a
shuffle; only those that cross blocks are put together by grouping.

Quotes follow the rules of Spark's own reader: a quote opens only at the start of
a field, a doubled quote inside quotes is a quote, and text after a closing quote
makes the field an unquoted one up to the next separator. Line breaks are
``\\n`` or ``\\r\\n`` (inside quotes read as ``\\n``); empty lines between records are
left out; a quote never closed takes the rest of its file into one record.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.session import shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors need no copy of this module

#: States of the walk over a line: start of a field, within an unquoted field,
#: within quotes, after a quote within quotes; the last two are entries.
START, MIDDLE, QUOTED, AFTER, OUTSIDE, INSIDE = range(6)


def _ends_inside(line: Column, entry: int, sep: str) -> Column:
    """1 where a line that is entered in this state ends inside quotes."""

    def step(state, part):
        at = F.when(state.isin(OUTSIDE), START).when(state.isin(INSIDE, START, AFTER), QUOTED).when(state == QUOTED, AFTER).otherwise(MIDDLE)
        return F.when((at == QUOTED) | (part == ""), at).when(part.endswith(sep), START).otherwise(MIDDLE)

    walked = F.aggregate(F.split(line, '"'), F.lit(entry), step, lambda state: (state == QUOTED).cast("int"))
    return F.when(~line.contains('"'), int(entry == INSIDE)).otherwise(walked)


def _states(out, into, entry: int):
    """State before each line (1: inside quotes) and after the last one, of
    consecutive lines that end in ``out`` or, entered inside, in ``into``."""
    turns = np.cumsum(out > into) - (out > into)
    last = np.maximum.accumulate(np.where(out == into, np.arange(len(out)), -1))
    last = np.concatenate([[-1], last[:-1]])
    base = np.where(last >= 0, out[last], entry)
    state = (base + turns - np.where(last >= 0, turns[last], 0)) % 2
    return state, int(into[-1] if state[-1] else out[-1])


def _runs(batch):
    """(first, end) of the rows of one block within a batch."""
    file, block = (batch.column(i).to_numpy() for i in (0, 1))
    cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    return zip([0, *cut], [*cut, len(file)]) if len(file) else []


def _effects(batches):
    """What each block makes of either state: where it ends, and how many
    records start in it."""
    key, ends, starts = None, [0, 1], [0, 0]

    def done():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *ends, *starts)], names=["file", "block", "end0", "end1", "starts0", "starts1"])

    for batch in batches:
        out, into, text = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for a, b in _runs(batch):
            here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            if here != key:
                if key:
                    yield done()
                key, ends, starts = here, [0, 1], [0, 0]
            for k in (0, 1):
                state, ends[k] = _states(out[a:b], into[a:b], ends[k])
                starts[k] += int(((state == 0) & text[a:b]).sum())
    if key:
        yield done()


def _walk(batches):
    """Records, and pieces of those that cross blocks (``whole`` is false)."""
    names = ["file", "block", "record", "text", "whole"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    key, state, number, held, begun = None, 0, 0, [], False

    def rows_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    for batch in batches:
        out, into, text, entry, past = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5, 6))
        lines, found = batch.column(7).to_pylist(), []
        for a, b in _runs(batch):
            here = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
            if here != key:
                if held:
                    found.append((*key, number, "\n".join(held), False))
                key, state, number, held, begun = here, int(entry[a]), int(past[a]), [], False
            before, state = _states(out[a:b], into[a:b], state)
            starts = (before == 0) & text[a:b]
            stays = np.where(before == 0, out[a:b], into[a:b]) == 1
            for i in np.flatnonzero(starts | (before == 1)):
                if starts[i]:
                    number, begun = number + 1, True
                held.append(lines[a + i])
                if not stays[i]:
                    found.append((*key, number, "\n".join(held), begun))
                    held, begun = [], False
        if found:
            yield rows_of(found)
    if held:
        yield rows_of([(*key, number, "\n".join(held), False)])


def _kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, "csv-records", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file (a hash of its path), record (1-based number in the file, the header
    being 1) and text of every record, from a table in the shared folder."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")).alias("line"),
    )
    ends = lines.select("file", "block", _ends_inside(F.col("line"), OUTSIDE, sep).alias("out"), _ends_inside(F.col("line"), INSIDE, sep).alias("into"), (F.col("line") != "").alias("text"), "at", "line")
    blocks = ends.select("file", "block", "out", "into", "text").mapInArrow(_effects, "file long, block long, end0 long, end1 long, starts0 long, starts1 long")
    # a block fixes the state, turns it over or keeps it; so do the blocks before one
    blocks = blocks.withColumn("fixed", F.when(F.col("end0") == F.col("end1"), F.col("end0"))).withColumn("turns", (F.col("end0") > F.col("end1")).cast("int"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    blocks = blocks.withColumn("known", F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")), ignorenulls=True).over(before))
    entry = (F.coalesce(F.col("known.fixed"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("known.turned"), F.lit(0))) % 2
    blocks = blocks.withColumn("entry", entry.cast("long")).withColumn("starts", F.when(F.col("entry") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    blocks = _kept(blocks.select("file", "block", "entry", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("past")))
    # however the join is made, the lines of a block are together; the sort puts them in order
    joined = ends.join(blocks, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    joined = joined.select("file", "block", "out", "into", "text", "entry", "past", "line")
    walked = _kept(joined.mapInArrow(_walk, "file long, block long, record long, text string, whole boolean"))
    short = walked.filter("whole").select("file", "record", "text")
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    long = walked.filter("not whole").groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return short.union(long)


def read(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The rows of CSV files with a header each, all columns as strings; a row
    with the wrong number of fields fails the read."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    names = spark.read.options(**options).csv(path, header=True, multiLine=True).columns  # opens one file, up to its first record
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, path, sep).filter("record > 1").select(F.from_csv("text", fields, options).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
