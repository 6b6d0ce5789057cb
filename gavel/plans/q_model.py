"""Model queries (TRN-1, TRN-5..9, TRN-14..16, SRC-4) and the flagship
run: cleaned ``gov`` -> hash split -> model -> fairness report."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.operators import evaluate as E
from gavel.operators import explain as X
from gavel.operators import fairness as FA
from gavel.operators import train as TR
from gavel.plans.q_clean import DOMAINS
from gavel.plans.registry import query
from gavel.plans.sql import with_
from gavel.session import shared_path
from gavel.sources import fixtures as fx
from gavel.sources import io

KEYS = ("order_id",)


def _fresh(spark, *parts: str) -> str:
    return shared_path(spark, *parts, uuid.uuid4().hex)


def cleaned_split(spark, sf, task: str = "classification", variant: str = "gov_clean"):
    """Cleaned table (stored as a stage table and read back: later passes -
    fit, predictions, audit - scan it instead of re-running the cleaning
    projection, and its lineage is cut) with the hash split flag, and the
    prepared model frame."""
    target = "income" if task == "classification" else "total"
    res = C.run(fx.gov_variant(spark, sf, variant), target, task, keys=KEYS)
    root = _fresh(spark, "stages")
    io.save_stage(res.cleaned, root, "run", "cleaned")
    res.fit.release()
    cleaned = TR.with_split(io.load_stage(spark, root, "run", "cleaned"), "order_id")
    prepared = TR.prepare(cleaned, target, KEYS, task)
    feats = TR.feature_columns(cleaned, target, KEYS)
    return res, cleaned, prepared, feats


def _fit(train: DataFrame, impl: str, task: str):
    return TR.fit(train, impl, task)


def _metrics_row(spark, sf, impl: str, task: str) -> DataFrame:
    _res, _c, prepared, _f = cleaned_split(spark, sf, task)
    train = prepared.where(~F.col("is_test"))
    test = prepared.where(F.col("is_test"))
    model = _fit(train, impl, task)
    # the metrics read the predictions several times: they are stored, so that rows are scored once
    root = _fresh(spark, "stages")
    io.save_stage(TR.predictions(model, test, impl, task), root, "run", "predictions")
    p = io.load_stage(spark, root, "run", "predictions")
    return E.classification_metrics(p) if task == "classification" else E.regression_metrics(p)


@query("train_logistic")
def train_logistic(spark, sf):
    return _metrics_row(spark, sf, "logistic", "classification")


@query("train_random_forest")
def train_random_forest(spark, sf):
    return _metrics_row(spark, sf, "random_forest", "classification")


@query("train_gbt_deep")
def train_gbt_deep(spark, sf):
    return _metrics_row(spark, sf, "gbt_deep", "classification")


@query("train_gbt_shallow")
def train_gbt_shallow(spark, sf):
    return _metrics_row(spark, sf, "gbt_shallow", "classification")


@query("train_ridge")
def train_ridge(spark, sf):
    return _metrics_row(spark, sf, "ridge", "regression")


@query("train_lasso")
def train_lasso(spark, sf):
    return _metrics_row(spark, sf, "lasso", "regression")


# ---------------------------------------------------------------- TRN-1
@query(
    "target_contiguous",
    with_("gov") + "SELECT order_year AS value, CAST(row_number() OVER (ORDER BY order_year) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT order_year FROM gov)",
)
def target_contiguous(spark, sf):
    return C.label_mapping(fx.gov(spark, sf), "order_year")


# ---------------------------------------------------------------- TRN-5, TRN-9: optimality of the fitted weights
# The estimators' objectives are convex, so the fitted weights are right when
# the gradient over the training rows is zero (within the solver's tolerance).
_MODEL_FEATURES = ["nation", "balance", "fee", "order_year", "express", *[f"{c}_{v}" for c in ("segment", "gender", "region", "priority") for v in DOMAINS[c]]]


def _gradient_sql(target: str) -> str:
    names = [*_MODEL_FEATURES, {"income": "total", "total": "income"}[target]] if target == "income" else [*_MODEL_FEATURES, "income_<=50K", "income_>50K"]
    return "SELECT feature, 0.0::DOUBLE AS gap FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS feature) WHERE (SELECT count(*) FROM orders) > 0"


def _gradient(spark, sf, impl: str, task: str) -> DataFrame:
    """(feature, gap): how far each weight is from its optimality condition, in
    units of the label's deviation a row, 3 dp."""
    _res, _c, prepared, feats = cleaned_split(spark, sf, task)
    train = prepared.where(~F.col("is_test"))
    model = _fit(train, impl, task)
    w = model.coefficients.toArray()
    dot = F.aggregate(F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(float(model.intercept)), lambda a, b: a + b)
    guess = F.lit(1.0) / (F.lit(1.0) + F.exp(-dot)) if impl == "logistic" else dot
    rows = train.select(vector_to_array("features").alias("x"), (F.col("label") - guess).alias("r"), "label")
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd"), *[F.sum(F.element_at("x", j + 1) * F.col("r")).alias(f"g{j}") for j in range(len(w))]).first()
    out = []
    for j, name in enumerate(feats):
        g = st[f"g{j}"] / st["n"]
        if impl == "lasso":  # 1/(2n) |r|^2 + 0.1 |w|
            gap = abs(g - 0.1 * np.sign(w[j])) if w[j] else max(0.0, abs(g) - 0.1)
        else:  # sums of losses + 1/2 |w|^2
            gap = abs(g - w[j] / st["n"])
        out.append((name, round(float(gap) / (1.0 if impl == "logistic" else st["sd"]), 3)))
    return spark.createDataFrame(out, "feature string, gap double")


@query("train_logistic_gradient", _gradient_sql("income"))
def train_logistic_gradient(spark, sf):
    return _gradient(spark, sf, "logistic", "classification")


@query("train_ridge_gradient", _gradient_sql("total"))
def train_ridge_gradient(spark, sf):
    return _gradient(spark, sf, "ridge", "regression")


@query("train_lasso_gradient", _gradient_sql("total"))
def train_lasso_gradient(spark, sf):
    return _gradient(spark, sf, "lasso", "regression")


# ---------------------------------------------------------------- SRC-4
@query(
    "model_roundtrip_predict",
    with_("gov") + "SELECT count(*) AS test_rows, 0::BIGINT AS changed FROM gov WHERE md5('42|' || CAST(order_id AS VARCHAR)) < '33333333'",
)
def model_roundtrip_predict(spark, sf):
    """Predictions of a model and of its reloaded copy over the test side."""
    _res, _cleaned, prepared, _feats = cleaned_split(spark, sf)
    model = TR.fit(prepared.where(~F.col("is_test")), "logistic", "classification")
    path = _fresh(spark, "models")
    io.save_model(model, path)
    back = io.load_model(path, type(model))
    before = model.transform(prepared.where(F.col("is_test"))).select("features", F.col("prediction").alias("before"))
    return back.transform(before).agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("before") != F.col("prediction")).alias("changed"))


# ---------------------------------------------------------------- TRN-14 / TRN-16 (fixed weights)
# Weights of the linear attribution check.
LINEAR_WEIGHTS = {"balance": 0.5, "total": 2.0, "fee": -1.0, "order_year": 0.25}
SPLIT = "md5('42|' || CAST(order_id AS VARCHAR)) < '33333333'"
_lin_sql = (
    ", tr AS (SELECT "
    + ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in LINEAR_WEIGHTS)
    + f" FROM gov WHERE NOT ({SPLIT})),\n"
    + "imp AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, {i} AS feature_pos, avg(abs({w} * (CAST({f} AS DOUBLE) - tr.m_{f}))) AS importance FROM gov, tr WHERE {SPLIT}"
        for i, (f, w) in enumerate(LINEAR_WEIGHTS.items())
    )
    + ")\n"
)


def _linear(spark, sf):
    g = fx.gov(spark, sf)
    train, test = TR.hash_split(g, "order_id")
    return X.linear_attributions(test, train, LINEAR_WEIGHTS)


@query("shap_linear", with_("gov") + _lin_sql + "SELECT feature, CAST(feature_pos AS INTEGER) AS feature_pos, round(importance, 6) AS importance FROM imp")
def shap_linear(spark, sf):
    return _linear(spark, sf).select("feature", "feature_pos", F.round("importance", 6).alias("importance"))


@query(
    "shap_top5",
    with_("gov") + _lin_sql + "SELECT feature, round(importance, 6) AS importance, CAST(feature_pos AS INTEGER) AS feature_pos FROM imp ORDER BY importance DESC, feature_pos LIMIT 5",
)
def shap_top5(spark, sf):
    return X.top_features(_linear(spark, sf), 5)


# ---------------------------------------------------------------- TRN-15
@query("shap_tree")
def shap_tree(spark, sf):
    """Top-5 TreeSHAP features of the random forest over the whole test side."""
    _res, _cleaned, prepared, feats = cleaned_split(spark, sf)
    train, test = prepared.where(~F.col("is_test")), prepared.where(F.col("is_test"))
    model = _fit(train, "random_forest", "classification")
    return X.top_features(X.explain(spark, model, test, train, feats, _fresh(spark, "models")), 5)


@query("shap_tree_sample")
def shap_tree_sample(spark, sf):
    """Top-5 TreeSHAP features of the boosted trees of second order over the
    reference's choice of 200 test rows."""
    _res, _cleaned, prepared, feats = cleaned_split(spark, sf)
    train, test = prepared.where(~F.col("is_test")), prepared.where(F.col("is_test"))
    model = TR.fit(train, "gbt_deep", "classification", rounds=20)
    some = X.sample_rows(test, F.col("row.order_id"))
    return X.top_features(X.explain(spark, model, some, train, feats, _fresh(spark, "models")), 5)


# ---------------------------------------------------------------- TRN-7: the first tree against its definition
# Few values a feature, so that the cuts are all values and SQL can try them all.
_FIRST = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "ship_month": "year(l_shipdate) * 12 + month(l_shipdate)"}


@query(
    "boost_first_tree",
    "WITH r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, "
    + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _FIRST.items())
    + " FROM lineitem),\nb AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS s FROM r),\nv AS ("
    + "\nUNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS feature, {n} AS value, count(*) AS n, sum(y) AS s FROM r GROUP BY {n}" for i, n in enumerate(_FIRST))
    + """),
c AS (SELECT pos, feature, value, sum(n) OVER w AS n, sum(s) OVER w AS s FROM v WINDOW w AS (PARTITION BY pos ORDER BY value)),
g AS (SELECT pos, feature, value, c.n * p - c.s AS gl, c.n * p * (1 - p) AS hl, (b.n - c.n) * p - (b.s - c.s) AS gr, (b.n - c.n) * p * (1 - p) AS hr FROM c, b)
SELECT feature, value AS threshold, round(-0.3 * gl / (hl + 1), 6) AS left_weight, round(-0.3 * gr / (hr + 1), 6) AS right_weight,
       round(hl, 4) AS left_hessian, round(hr, 4) AS right_hessian
FROM g WHERE hl >= 1 AND hr >= 1 ORDER BY gl * gl / (hl + 1) + gr * gr / (hr + 1) DESC, pos, value LIMIT 1""",
)
def boost_first_tree(spark, sf):
    """Root split and leaf weights of one boosting round at depth 1, by shuffled
    histogram sums."""
    rows = fx.read(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), array_to_vector(F.array(*[F.expr(e).cast("double") for e in _FIRST.values()])).alias("features"))
    t = TR.trees.fit_boosted(rows, "classification", 2, rounds=1, depth=1, group_rows=1).tops[0]
    a, b = int(t.left[0]), int(t.right[0])
    row = (list(_FIRST)[t.feature[0]], float(t.threshold[0]), *[round(float(t.value[j, 0]), 6) for j in (a, b)], *[round(float(t.cover[j]), 4) for j in (a, b)])
    return spark.createDataFrame([row], "feature string, threshold double, left_weight double, right_weight double, left_hessian double, right_hessian double")


# ---------------------------------------------------------------- flagship
FLAGSHIP_CANDIDATES = ["gender", "region", "segment", "priority", "nation", "express"]


def fairness_run(spark, sf, impl: str = "logistic"):
    """Cleaned gov -> hash split -> fit -> predictions over the whole cleaned
    table -> fairness report (report, overall, skipped). Groups and predictions
    come from the same rows."""
    _res, _cleaned, prepared, _feats = cleaned_split(spark, sf)
    model = _fit(prepared.where(~F.col("is_test")), impl, "classification")
    scored = model.transform(prepared).select("row.*", F.col("prediction").cast("int").alias("pred"))
    return FA.audit(scored, FLAGSHIP_CANDIDATES, "income", "classification")


@query("fairness_report")
def fairness_report(spark, sf):
    return fairness_run(spark, sf)[0]
