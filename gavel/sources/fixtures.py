"""Fixture tables derived by Spark from the given TPC-H-ish parquet tables.

* ``gov`` - one row per order, the governed table (stands in for a census
  table): categorical, numeric and boolean features, a sensitive attribute
  and a two-class target.
* null variants ``gov_clean`` / ``gov_failing`` / ``gov_fixable``: nulls
  injected deterministically from the key, so Spark and DuckDB agree.
* ``run_events`` - the governance event log, one row per ``events`` row.
* ``plan_texts`` - one raw plan text per planner event.

Every fixture grows with its source tables; nothing is made up on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.session import table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Under-partitioned input (a few single-row-group files) would run every
    map stage in one task: spread it over the cluster's default parallelism.
    Inputs that already span more partitions are left alone."""
    dp = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(dp) if df.rdd.getNumPartitions() < dp else df


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _source_stamp(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Fingerprint of the source files (path, length, modification time)."""
    import hashlib

    parts = []
    for n in names:
        p, fs = _hadoop_fs(spark, table_path(sf_dir, n))
        for st in fs.listStatus(p):
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.md5("|".join(sorted(parts)).encode()).hexdigest()[:16]


def gov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The governed table, derived once per source folder and stored as
    Parquet in the shared folder (keyed by a fingerprint of the source
    files); later reads get column pruning and filter push-down instead of
    re-running the four-way join."""
    from gavel.session import shared_path

    path = shared_path(spark, "fixtures", _source_stamp(spark, sf_dir, ["orders", "customer", "nation", "region"]), "gov")
    marker, fs = _hadoop_fs(spark, path + "/_SUCCESS")
    if not fs.exists(marker):
        spread(gov_join(spark, sf_dir)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def gov_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation x region, projected to governance columns.

    No join hints: nation/region are tiny parquet files, so Catalyst's size
    statistics broadcast them; customer vs orders is left to the planner and
    AQE (sort-merge at scale, runtime broadcast when small).
    """
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    female = (F.col("o_custkey") % 2) == 0
    threshold = F.when(female, F.lit(400000)).otherwise(F.lit(330000))
    return j.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("c_mktsegment").alias("segment"),
        F.when(female, "F").otherwise("M").alias("gender"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_totalprice").alias("total"),
        (F.col("o_totalprice") * F.lit(0.07).cast("double") + F.col("c_acctbal")).alias("fee"),
        F.year("o_orderdate").cast("int").alias("order_year"),
        ((F.col("o_orderkey") % 7) == 0).alias("express"),
        F.when(F.col("o_totalprice") > threshold, ">50K").otherwise("<=50K").alias("income"),
    )


def _null_when(cond: Column, name: str) -> Column:
    return F.when(~cond, F.col(name)).alias(name)


def _with_nulls(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.select(*[_null_when(rules[c], c) if c in rules else F.col(c) for c in df.columns])


def gov_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6 % null priority (flags), exactly 5 % null balance (must not flag)."""
    k = F.col("order_id") % 100
    return _with_nulls(gov(spark, sf_dir), {"priority": k < 6, "balance": k.between(10, 14)})


def gov_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """35 % null target, 60 % nulls in three categorical features."""
    oid = F.col("order_id")
    return _with_nulls(
        gov(spark, sf_dir),
        {
            "income": (oid % 100) < 35,
            "segment": ((oid * 7 + 1) % 100) < 60,
            "priority": ((oid * 7 + 2) % 100) < 60,
            "nation": ((oid * 7 + 3) % 100) < 60,
        },
    )


def gov_fixable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """42 % nulls in one feature: fails the gate until the plan drops it."""
    return _with_nulls(gov(spark, sf_dir), {"priority": (F.col("order_id") % 100) < 42})


def gov_variant(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return {
        "gov": gov,
        "gov_clean": gov_clean,
        "gov_failing": gov_failing,
        "gov_fixable": gov_fixable,
    }[variant](spark, sf_dir)


# ---------------------------------------------------------------------------
# Governance event log derived from ``events``
# ---------------------------------------------------------------------------

# Mapping of source event types to governance event types, and
# the decision / model labels chosen by key.
EVENT_TYPE_MAP = {
    "view": "planner_run",
    "signup": "data_agent_run",
    "click": "training_run",
    "error": "fairness_run",
    "purchase": "human_decision",
}
DECISIONS = ["approve", "reject_data_quality", "reject_model_or_fairness"]
MODELS = ["LogisticRegression", "RandomForest", "GradientBoosting"]


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log (run_id, seq, ts, event_type, event_source, summary,
    details). ``details`` is JSON text as a run writes it, or the unparsable
    text ``bad`` for every 50th event. Pure projection of ``events``: no
    shuffle."""
    e = spread(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    etype = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_TYPE_MAP.items()])
    base = e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        # naive (wall-clock) time as stored: formatting and ordering do not
        # depend on the session time zone
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        etype.alias("event_type"),
    )
    seq, et = F.col("seq"), F.col("event_type")
    typed = base.select(
        "*",
        F.when(et == "human_decision", "human_reviewer").otherwise("automated").alias("event_source"),
        F.when(et == "data_agent_run", (seq % 4) != 0).alias("quality_passed"),
        F.when(et == "human_decision", _pick(DECISIONS, seq)).alias("decision"),
        F.when(et == "training_run", _pick(MODELS, seq)).alias("model"),
    )
    q = F.lit('"')
    body = (
        F.when(et == "data_agent_run", F.concat(F.lit('{"quality_report":{"quality_check_passed":'), F.col("quality_passed").cast("string"), F.lit("}}")))
        .when(et == "human_decision", F.concat(F.lit('{"human_decision":"'), F.col("decision"), F.lit('"}')))
        .when(et == "training_run", F.concat(F.lit('{"selected_model_name":"'), F.col("model"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"event_type":"'), et, q, F.lit("}")))
    )
    summary = F.concat(F.lit("event "), seq.cast("string"), F.lit(": "), F.replace(et, F.lit("_"), F.lit(" ")))
    out = typed.withColumn("summary", summary).withColumn("details", F.when((seq % 50) == 0, F.lit("bad")).otherwise(body))
    return out.select("run_id", "seq", "ts", "event_type", "event_source", "summary", "details")


def _pick(values: list[str], seq: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (seq % len(values) + 1).cast("int"))


# ---------------------------------------------------------------------------
# Raw plan texts: one per planner event, ten shapes chosen by the event id
# ---------------------------------------------------------------------------

# Model-name spellings a planner may produce.
PLAN_MODEL_NAMES = [
    "LogisticRegression", "Random Forest", "XGBoost", "gradient-boosting", "Ridge",
    "lasso_regression", "SVM", "NeuralNet", "logistic",
]


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, run_id, raw): the plan text a planner event produced.
    Shapes by plan_id % 10: 0 valid, 1 fenced, 2 list field as a string,
    3 missing key, 4 broken JSON, 5 explicit drop step, 6 SMOTE step,
    7 class-weight step, 8 substring trap step, 9 empty candidates with
    protected_attributes."""
    ev = run_events(spark, sf_dir).where(F.col("event_type") == "planner_run").select(F.col("seq").alias("plan_id"), "run_id")
    pid = F.col("plan_id")
    shape = pid % 10
    m1 = _pick(PLAN_MODEL_NAMES, pid)
    m2 = _pick(PLAN_MODEL_NAMES, F.floor(pid / 9).cast("long"))
    steps = (
        F.when(shape == 5, F.lit('["Drop column priority", "Impute missing values"]'))
        .when(shape == 6, F.lit('["Apply SMOTE oversampling"]'))
        .when(shape == 7, F.lit('["Use class weight balancing"]'))
        .when(shape == 8, F.lit('["Remove surnamed totals"]'))
        .otherwise(F.lit('["Impute missing values", "Scale numeric features"]'))
    )
    models = F.when(shape == 2, F.concat(F.lit('"'), m1, F.lit('"'))).otherwise(F.concat(F.lit('["'), m1, F.lit('", "'), m2, F.lit('"]')))
    cands = F.when(shape == 9, F.lit('[], "protected_attributes": ["gender"]')).otherwise(F.lit('["gender", "region"]'))
    reasoning = F.when(shape == 3, F.lit("")).otherwise(F.concat(F.lit(', "reasoning": "plan '), pid.cast("string"), F.lit('"')))
    body = F.concat(
        F.lit('{"data_quality_concerns": ["High null rate in priority"], "recommended_preprocessing_steps": '), steps,
        F.lit(', "recommended_models": '), models,
        F.lit(', "sensitive_attribute_candidates": '), cands, reasoning, F.lit("}"),
    )
    raw = (
        F.when(shape == 1, F.concat(F.lit("  ```json\n"), body, F.lit("\n```  ")))
        .when(shape == 4, F.concat(F.lit('{"data_quality_concerns": ["x"], "recommended_models": ["'), m1, F.lit('"')))
        .otherwise(body)
    )
    return ev.select("plan_id", "run_id", raw.alias("raw"))
