"""Training (TRN-1, TRN-2, TRN-5..9) with Spark ML.

Splits are deterministic hash splits (no sampling, no shuffle): a row is in
the test side when ``md5('<seed>|' || key)`` is below the 20 % point of the
hash space. The stratified variant takes, per class, the ``ceil(0.2 n_c)``
rows with the smallest hash; ranks come from ``weight_before``, a
range-partitioned prefix sum (never a window over a whole class). What is looked
up by class (a size, a hash) is broadcast: one row a class.

Model mapping (regularisation as in the reference's estimators):
logistic C=1 -> regParam 1/n, no standardisation; random forest 100 trees
without a depth limit and boosted trees of second order (100 rounds, depth 6,
rate 0.3) -> ``operators.trees``; first-order boosted trees (100 rounds, depth
3, rate 0.1, one-vs-rest beyond two classes) -> Spark ML; ridge alpha 1 ->
regParam alpha*std_pop(y)/n with the normal solver; lasso alpha 0.1 -> regParam
0.1.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import col
from gavel.functions.stats import pinned, weight_before
from gavel.operators import trees

SEED = 42
TEST_FRACTION = 0.20
#: Rows of a partition that a Spark ML solver keeps.
FIT_ROWS = 1 << 18


def split_key(key: str, seed: int = SEED):
    return F.md5(F.concat(F.lit(f"{seed}|"), col(key).cast("string")))


def _threshold(frac: float) -> str:
    """Hex prefix of the md5 space at ``frac`` (0.2 -> '33333333')."""
    return f"{int(frac * 0xFFFFFFFF):08x}"


def with_split(df: DataFrame, key: str, frac: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    return df.withColumn("is_test", split_key(key, seed) < F.lit(_threshold(frac)))


def hash_split(df: DataFrame, key: str, frac: float = TEST_FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test): two filters over the same scan, no shuffle."""
    s = split_key(key, seed) < F.lit(_threshold(frac))
    return df.where(~s), df.where(s)


def stratified_split(df: DataFrame, key: str, label: str, frac: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: per class, the ceil(frac * n_class) rows with the
    smallest hash key. Only (class, hash) is ranked; the last hash of each
    class's test side is then looked up by class."""
    marked = df.withColumn("__hk", split_key(key, seed)).withColumn("__cls", F.coalesce(col(label).cast("string"), F.lit("")))
    hashes = marked.groupBy("__cls", "__hk").agg(F.count(F.lit(1)).alias("__one"))
    ranked = weight_before(hashes, "__cls", "__hk", "__one")
    # a join by class would send all rows of a class to one task
    sizes = F.broadcast(ranked.groupBy("__cls").agg(F.ceil(F.sum("__one") * frac).alias("__k")))
    last = ranked.join(sizes, "__cls").where(F.col("before") < F.col("__k")).groupBy("__cls").agg(F.max("__hk").alias("__last"))
    return marked.join(F.broadcast(pinned(last)), "__cls", "left").withColumn("is_test", F.coalesce(F.col("__hk") <= F.col("__last"), F.lit(False))).drop("__hk", "__cls", "__last")


# ---------------------------------------------------------------------------
# features and models
# ---------------------------------------------------------------------------

def feature_columns(df: DataFrame, target: str, keys: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != target and f.name not in keys and f.name != "is_test"]


def prepare(df: DataFrame, target: str, keys: tuple[str, ...], task: str, classes: DataFrame | None = None) -> DataFrame:
    """PRJ-7 / PRJ-8 / TRN-1: (row, is_test, label, features). ``row`` holds the
    cleaned row itself, so predictions can be audited without a join back.
    Booleans enter the features as 0/1, NULL as NaN; with ``classes`` (value,
    code) the label is the code 0..K-1 of the sorted class values."""
    feats = feature_columns(df, target, keys)
    vector = array_to_vector(F.array(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))) for c in feats]))
    rows = df.select(F.struct(*[col(c) for c in df.columns if c != "is_test"]).alias("row"), (F.col("is_test") if "is_test" in df.columns else F.lit(False)).alias("is_test"), col(target).alias("__t"), vector.alias("features"))
    if task == "classification" and classes is not None:
        codes = classes.select(F.col("value").alias("__v"), F.col("code"))
        rows = rows.join(codes, F.col("__t") == F.col("__v"), "left")
        label = F.col("code")
    else:
        label = F.col("__t")
    return rows.select("row", "is_test", label.cast("double").alias("label"), "features")


def fit_rows(train: DataFrame, n: int) -> DataFrame:
    """What Spark ML fits, (label, features), in partitions of about ``FIT_ROWS``
    rows: the solvers keep and read whole partitions at every iteration."""
    lean, parts = train.select("label", "features"), -(-n // FIT_ROWS)
    return lean.repartition(parts) if parts > lean.sparkSession.sparkContext.defaultParallelism else lean


def estimator(impl: str, task: str, n_train: int, n_classes: int = 2, y_std: float | None = None):
    """The Spark ML estimator of a model that Spark ML has."""
    if impl == "gbt_shallow":
        if task == "classification":
            g = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
            return g if n_classes <= 2 else OneVsRest(classifier=g)
        return GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
    if task == "classification" and impl == "logistic":
        # tol 1e-4: the convergence tolerance of the reference estimator
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, family="auto", tol=1e-4)
    if task == "regression" and impl == "ridge":
        return LinearRegression(elasticNetParam=0.0, regParam=(y_std or 1.0) / max(n_train, 1), solver="normal", standardization=False)
    if task == "regression" and impl == "lasso":
        return LinearRegression(elasticNetParam=1.0, regParam=0.1, standardization=False)
    raise ValueError(f"no {task} implementation {impl!r}")


def fit(train: DataFrame, impl: str, task: str, n_classes: int | None = None, **options):
    """Fit one candidate on a prepared frame (label, features). One aggregate
    gives the row count, the label deviation and the number of classes.
    ``max_depth`` limits forests, ``rounds`` and ``depth`` second-order boosting."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd"), F.max("label").alias("top")).first()
    if n_classes is None:
        n_classes = max(2, int(r["top"] or 0) + 1) if task == "classification" else 2
    if impl == "random_forest":
        return trees.fit_forest(train, task, n_classes, seed=SEED, max_depth=options.get("max_depth", 0))
    if impl == "gbt_deep":
        return trees.fit_boosted(train, task, n_classes, rounds=options.get("rounds", 100), depth=options.get("depth", 6), seed=SEED)
    return estimator(impl, task, r["n"], n_classes, r["sd"]).fit(fit_rows(train, r["n"]))


def predictions(model, df: DataFrame, name: str, task: str) -> DataFrame:
    """Long prediction table (model, label, pred, score) / (model, y, yhat)."""
    p = model.transform(df)
    if task == "classification":
        score = F.element_at(vector_to_array("probability"), 2) if "probability" in p.columns else F.col("prediction")
        return p.select(F.lit(name).alias("model"), F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("pred"), score.alias("score"))
    return p.select(F.lit(name).alias("model"), F.col("label").alias("y"), F.col("prediction").alias("yhat"))
