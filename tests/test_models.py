"""Attributions of every model class, and splits."""

import itertools
import uuid
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gavel.operators import explain as X
from gavel.operators import train as TR
from gavel.session import shared_path


def test_tree_shap_matches_brute_force():
    t = X.Tree(
        left=np.array([1, 3, 5, -1, -1, -1, -1]), right=np.array([2, 4, 6, -1, -1, -1, -1]),
        feature=np.array([0, 1, 2, 0, 0, 0, 0]), threshold=np.array([0.5, 0.5, 0.5, 0, 0, 0, 0.0]),
        value=np.array([0, 0, 0, 1.0, 2.0, 3.0, 5.0]), cover=np.array([10, 6, 4, 2, 4, 1, 3.0]), weight=1.0,
    )

    def f(x, s):
        def rec(j):
            if t.left[j] < 0:
                return t.value[j]
            d = t.feature[j]
            if d in s:
                return rec(t.left[j] if x[d] <= t.threshold[j] else t.right[j])
            return (t.cover[t.left[j]] * rec(t.left[j]) + t.cover[t.right[j]] * rec(t.right[j])) / t.cover[j]
        return rec(0)

    xs = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    phi = np.zeros_like(xs)
    X._tree_shap(t, xs, phi, 1.0)
    m = 3
    for r, x in enumerate(xs):
        for i in range(m):
            others = [k for k in range(m) if k != i]
            v = 0.0
            for size in range(m):
                for s in itertools.combinations(others, size):
                    w = factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m)
                    v += w * (f(x, set(s) | {i}) - f(x, set(s)))
            assert abs(phi[r, i] - v) < 1e-12


def test_leaf_shares_are_computed_once_a_pattern(monkeypatch):
    """The work on a leaf is bounded by the patterns of its path's features, not by
    the rows; rows with missing values, subtrees and long paths included."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (5000, 12)).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    parts = [[], [], [], [], [], [], []]  # left, right, feature, threshold, value, cover, missing_left

    def add(cover, depth):
        j = len(parts[0])
        leaf = depth == 0 or cover < 2 or (depth < 9 and rng.random() < 0.15)
        for part, v in zip(parts, (-1, -1, rng.integers(12), rng.integers(3) + 0.5, rng.integers(2) if leaf else 0, cover, rng.random() < 0.5), strict=True):
            part.append(v)
        if not leaf:
            a = cover * rng.uniform(0.2, 0.8)
            parts[0][j] = add(a, depth - 1)
            parts[1][j] = add(cover - a, depth - 1)
        return j

    add(4000.0, 11)
    left, right, feature, threshold, value, cover, missing = map(np.array, parts)
    t = X.Tree(left, right, feature, threshold, value.astype(float), cover, 1.0, missing)
    start = {3: (0.5, 2.5, True, 0.4), 20: (-np.inf, 1.0, False, 0.7)}
    x = np.column_stack([x, np.zeros((5000, 7)), np.nan_to_num(x[:, :2])])
    sizes, share = [], X._pattern_shares
    monkeypatch.setattr(X, "_pattern_shares", lambda z, at, v: (sizes.append((len(z), share(z, at, v)[0].shape[1])), share(z, at, v))[1])
    for path in (None, start):
        for rows in (x[:40], x):
            got, want = np.zeros(rows.shape), np.zeros(rows.shape)
            X.tree_shares(t, rows, got, 0.5, path)
            X.leaf_shares(X.leaf_paths(t, path), rows, want, 0.5)
            assert np.allclose(got, want, atol=1e-12)
    assert len({n for n, _ in sizes}) > 4 and all(k <= max(64, 2**n) and k <= 5000 for n, k in sizes)
    assert np.abs(want).sum() > 0
    # more features than a pattern has bits
    monkeypatch.setattr(X, "PATTERN_BITS", 5)
    wide = np.zeros(x.shape)
    X.tree_shares(t, x, wide, 0.5, start)
    assert np.allclose(wide, want, atol=1e-12)


def test_subtrees_work_on_classes_of_rows(monkeypatch):
    """A small subtree works on the rows that its tests and its path tell apart, not
    on every row; missing values and the path of a subtree included."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(20_000, 6)), 2)
    x[:, 3:] = rng.integers(0, 2, (20_000, 3))
    x[rng.random(x.shape) < 0.02] = np.nan
    cover, left, right, feature, threshold, value, missing = [], [], [], [], [], [], []

    def add(rows, depth):
        j = len(left)
        leaf = depth == 0 or len(rows) < 20
        f = int(rng.integers(6))
        cut = float(np.nan_to_num(x[rng.choice(rows), f])) if len(rows) else 0.0
        for part, v in zip((left, right, feature, threshold, value, cover, missing), (-1, -1, -1 if leaf else f, cut, rng.integers(3) / 2, len(rows) + 1.0, rng.random() < 0.5), strict=True):
            part.append(v)
        if not leaf:
            on = np.where(np.isnan(x[rows, f]), missing[j], x[rows, f] <= cut)
            left[j] = add(rows[on], depth - 1)
            right[j] = add(rows[~on], depth - 1)
        return j

    add(np.arange(len(x)), 9)
    t = X.Tree(*map(np.array, (left, right, feature, threshold, value, cover)), 1.0, np.array(missing))
    worked, share = [], X._pattern_shares
    monkeypatch.setattr(X, "_pattern_shares", lambda z, at, v: (worked.append(len(at)), share(z, at, v))[1])
    for start in (None, {1: (-0.5, 1.5, True, 0.4)}):
        worked.clear()
        got, want = np.zeros(x.shape), np.zeros(x.shape)
        X.tree_shares(t, x, got, 0.5, start)
        X.leaf_shares(X.leaf_paths(t, start), x, want, 0.5)
        assert np.allclose(got, want, atol=1e-12) and np.abs(want).sum() > 0
        assert len(worked) > 50 and sum(worked) < len(worked) * len(x) / 5


def _prepared(spark, rows, task, classes=None):
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double")
    return TR.prepare(TR.with_split(df, "k"), "y", ("k",), task, classes)


def _rows(label):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    return [(i, *map(float, v), float(label(v))) for i, v in enumerate(x)]


BINARY = lambda v: v[0] + 0.5 * v[1] * v[2] > 0
THREE = lambda v: (v[0] > 0.3) + (v[0] + v[1] > 0.8)


@pytest.mark.parametrize("task,label", [("classification", BINARY), ("regression", lambda v: v[0] * v[1])])
def test_shallow_attributions_add_up(spark, task, label):
    """Local accuracy for Spark ML's boosted trees: attributions and base value
    sum to the model's output."""
    data = _prepared(spark, _rows(label), task)
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    model = TR.fit(train, "gbt_shallow", task)
    path = shared_path(spark, "tests", f"{task}-{uuid.uuid4().hex}")
    X.explain(spark, model, test, train, ["a", "b", "c"], path).collect()
    # of a classifier the margin, half of the raw prediction's spread
    y = F.col("prediction") if task == "regression" else F.element_at(vector_to_array("rawPrediction"), 2)
    trees = X.node_tables(spark, path)
    got = model.transform(test).select(vector_to_array("features").alias("x"), y.alias("y")).toPandas()
    phi, base = X.shap_values(trees, np.stack(got["x"].to_numpy()))
    assert np.abs(phi.sum(axis=1) + base - got["y"].to_numpy()).max() < 1e-6


def test_explanations_by_model_class(spark):
    for impl, task, label in (("logistic", "classification", THREE), ("logistic", "classification", BINARY), ("ridge", "regression", lambda v: 3 * v[0]), ("gbt_shallow", "classification", THREE)):
        data = _prepared(spark, _rows(label), task)
        train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
        model = TR.fit(train, impl, task)
        got = X.explain(spark, model, test, train, ["a", "b", "c"], shared_path(spark, "tests", uuid.uuid4().hex)).toPandas().set_index("feature").importance
        assert len(got) == 3 and got["a"] == got.max() and (got >= 0).all()


def test_stratified_split_takes_the_share_of_each_class(spark):
    df = spark.range(1000).selectExpr("id k", "if(id % 10 = 0, 'rare', 'common') t")
    got = {(r.t, r.is_test): r["count"] for r in TR.stratified_split(df, "k", "t").groupBy("t", "is_test").count().collect()}
    assert got == {("rare", True): 20, ("rare", False): 80, ("common", True): 180, ("common", False): 720}


def test_registered_forests_have_no_depth_limit(monkeypatch):
    from gavel.plans import q_model

    seen = {}
    monkeypatch.setattr(q_model.TR.trees, "fit_forest", lambda train, task, n, **kw: seen.update(kw))
    monkeypatch.setattr(q_model.TR, "fit", lambda train, impl, task, **kw: q_model.TR.trees.fit_forest(train, task, 2, max_depth=kw.get("max_depth", 0)))
    q_model._fit(None, "random_forest", "classification")
    assert seen == {"max_depth": 0}


def test_stratified_split_moves_no_rows_by_class(spark):
    df = spark.range(1000).selectExpr("id k", "if(id % 10 = 0, 'rare', 'common') t", "id * 2 v")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        split = TR.stratified_split(df, "k", "t")
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert split.where("is_test").count() == 200
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_solvers_keep_lean_rows_in_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(TR, "FIT_ROWS", 5)
    data = _prepared(spark, _rows(BINARY), "classification")
    seen = []
    monkeypatch.setattr(TR, "estimator", lambda *a: type("E", (), {"fit": lambda self, df: seen.append(df)})())
    TR.fit(data, "logistic", "classification")
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert seen[0].columns == ["label", "features"] and sum(sizes) == 400 and max(sizes) < 20


def test_test_rows_are_scored_once(spark, sf_small, monkeypatch):
    """The metrics read stored predictions: no branch of their plan runs the model again."""
    from gavel.plans import q_model

    fit, seen = TR.trees.fit_forest, []
    monkeypatch.setattr(q_model.TR, "fit", lambda train, impl, task: fit(train, task, 2, n_trees=2))
    monkeypatch.setattr(q_model.E, "classification_metrics", lambda p: seen.append(p) or p)
    assert q_model.train_random_forest(spark, sf_small).count() > 0
    assert "Python" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert seen[0].columns == ["model", "label", "pred", "score"]
