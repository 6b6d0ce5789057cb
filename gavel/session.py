"""Session helpers: building a local session for tests/bench and locating the
shared folder for stage tables and checkpoints.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names
(HDFS / object store). We only invent one when it is unset, which happens in
local tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gavel") -> SparkSession:
    master = f"local[{cores}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a fresh local one only
    when the session has none (tests, bench)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        # a machine-local folder is not shared by the executors of a cluster
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for this cluster")
    path = tempfile.mkdtemp(prefix="gavel-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder (never a machine-local temp dir on a
    cluster: the root comes from the session)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    # The checkpoint dir holds RDD checkpoints in uuid subfolders; keep our
    # tables apart from them.
    return "/".join([root, "gavel", *parts])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gavel`` importable in Python workers (the stateful fold and the
    TreeSHAP batches run there): zip the package once per Spark context and
    distribute it with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="gavel-pyfiles-"), "gavel.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
