"""Append-only audit-event table (SRC-5) and its reader (SRC-6).

The table is Parquet partitioned by ``event_date``; appends add files, never
rewrite them, and readers prune partitions by date and filter by run. A log of
several writers (``commit_events``) gets its ids from the order of its commits.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_COLUMNS = ["run_id", "seq", "ts", "event_type", "event_source", "summary", "details"]


def append_events(events: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append events (run_id, seq, ts, event_type, event_source, summary,
    details JSON text) to the table at ``path``."""
    out = events.select(*EVENT_COLUMNS).withColumn("event_date", F.to_date("ts"))
    out.write.mode("overwrite" if overwrite else "append").partitionBy("event_date").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a plain table (``append_events``) or of a committed log
    (``commit_events``), whose ids follow the order of the commits."""
    if _exists(spark, f"{path}/commits"):
        return read_committed(spark, path).select(*EVENT_COLUMNS)
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


COMMIT = "version long, token string, folder string, part int, start long, n long"
_STORED = "run_id string, ts timestamp_ntz, event_type string, event_source string, summary string, details string, at long, folder string, event_date date"
_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not _exists(spark, f"{path}/commits"):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json") and f.getPath().getName()[0].isdigit())


def _read_commit(spark: SparkSession, path: str, version: int) -> list[dict]:
    rows = spark.read.schema(COMMIT).json(f"{path}/commits/{version:020d}.json").collect()  # a row a written partition
    return [r.asDict() for r in rows]


def _claim(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """Publish commit ``version`` whole, unless another writer has it: a hard
    link in a local folder, a rename that never overwrites elsewhere (atomic on
    HDFS)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{version:020d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/drafts/{uuid.uuid4().hex}")
    fs = final.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), final.toUri().getPath())
        else:
            never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, never)
    except FileExistsError:
        return False
    except Py4JJavaError as err:
        if "FileAlreadyExistsException" not in err.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


def commit_events(events: DataFrame, path: str, token: str) -> bool:
    """Append events to the committed log at ``path``; whether this call did.

    The rows go to a folder of this attempt only, in the order of ``seq``. Then
    the attempt claims the next version of the log: the claim of a version is
    exclusive, and it names the first id of every written partition, which
    follows from the version before. So writers need no lock, ids are unique and
    without gaps in commit order, and nothing is read that another writer could
    still change. ``token`` names the append: a retried append whose first try
    was committed adds nothing. A folder that was never committed is not read.
    Each append looks through the list of commits once; no events add no commit."""
    spark, folder = events.sparkSession, uuid.uuid4().hex
    placed = events.select(*EVENT_COLUMNS).repartitionByRange("seq").sortWithinPartitions("seq")
    placed = placed.withColumn("at", F.monotonically_increasing_id()).drop("seq").withColumn("event_date", F.to_date("ts"))
    placed.write.partitionBy("event_date").parquet(f"{path}/batches/folder={folder}")
    part = F.shiftright("at", _ROW_BITS).cast("int").alias("part")
    sizes = spark.read.schema(_STORED).parquet(f"{path}/batches/folder={folder}").groupBy(part).count().orderBy("part").collect()
    if not sizes:
        return False
    known = _versions(spark, path)
    if known and not spark.read.schema(COMMIT).json(f"{path}/commits").where((F.col("token") == token) & (F.col("version") <= known[-1])).isEmpty():
        return False
    version = known[-1] + 1 if known else 0
    end = max((c["start"] + c["n"] for c in _read_commit(spark, path, version - 1)), default=0) if version else 0
    while True:
        start, lines = end, []
        for r in sizes:
            lines.append(json.dumps({"version": version, "token": token, "folder": folder, "part": r["part"], "start": start, "n": r["count"]}))
            start += r["count"]
        if _claim(spark, path, version, "\n".join(lines) + "\n"):
            return True
        other = _read_commit(spark, path, version)
        if any(c["token"] == token for c in other):
            return False
        end, version = max(c["start"] + c["n"] for c in other), version + 1


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The events of a committed log with their ids (``seq``, from 1) and the
    ``token`` of their append."""
    commits = spark.read.schema(COMMIT).json(f"{path}/commits").select("token", "folder", "part", "start")
    rows = spark.read.schema(_STORED).parquet(f"{path}/batches").withColumn("part", F.shiftright("at", _ROW_BITS).cast("int"))
    seq = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return rows.join(commits, ["folder", "part"]).withColumn("seq", seq).select(*EVENT_COLUMNS, "token")


def new_events(spark: SparkSession, rows: list[tuple], ts=None) -> DataFrame:
    """Events from driver-side values (one row per call of the workflow): the
    timestamp is the current UTC wall-clock time (naive) unless given."""
    df = spark.createDataFrame(rows, "run_id string, seq long, event_type string, event_source string, summary string, details string")
    now_utc = F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return df.withColumn("ts", now_utc if ts is None else F.lit(ts).cast("timestamp_ntz")).select(*EVENT_COLUMNS)
