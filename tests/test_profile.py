"""Profiling traps: thresholds, NaN, constant columns, histogram edges."""

import math

import numpy as np
from pyspark.sql import functions as F

from gavel.functions.exprs import normalise_nan
from gavel.operators import profile as P


def test_null_flag_threshold_is_strict(spark):
    rows = [(i, None if i < 5 else 1.0, "a" if i % 2 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, "k long, x double, t string")
    flags = P.quality_flags(df, "t", "classification").collect()
    assert not [f for f in flags if f["kind"] == "null_rate"]  # exactly 5 % does not flag


def test_nan_is_null_after_normalisation(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    prof = P.profile_columns(normalise_nan(df)).first()
    assert prof["null_count"] == 2 and prof["cardinality"] == 1


def test_constant_column_correlation_is_skipped_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 6.3, 5.0)], "a double, b double, c double")
    out = P.correlations_top(df).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in out] == [("a", "b")]


def test_skew_matches_bias_corrected_formula(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 9.0, 4.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "y double")
    got = P.target_numeric_stats(df, "y").first()["skew"]
    a = np.array(xs)
    n = len(a)
    m2 = ((a - a.mean()) ** 2).mean()
    m3 = ((a - a.mean()) ** 3).mean()
    g1 = m3 / m2 ** 1.5
    assert math.isclose(got, round(g1 * math.sqrt(n * (n - 1)) / (n - 2), 4))


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    xs = np.round(rng.normal(50, 10, 500), 2)
    df = spark.createDataFrame([(float(x),) for x in xs], "y double")
    got = [r["n"] for r in P.target_histogram(df, "y").orderBy("bin").collect()]
    want, _ = np.histogram(xs, bins=10)
    assert got == list(want)


def test_histogram_not_for_few_distinct_values(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)], "y double")
    assert P.target_histogram(df, "y").count() == 0


def test_top_categories_tie_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), ("b",)], "c string")
    got = [(r["value"], r["n"]) for r in P.top_categories(df, 2).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2)]


def test_profile_invariant_under_repartitioning(spark, sf_small):
    from gavel.sources import fixtures as fx

    df = fx.gov_clean(spark, sf_small)
    a = sorted(map(tuple, P.profile_columns(df).collect()))
    b = sorted(map(tuple, P.profile_columns(df.repartition(5, F.col("segment"))).collect()))
    assert a == b


def test_cardinality_of_long_ids_is_exact(spark):
    df = spark.createDataFrame([(2**53, 0.0), (2**53 + 1, -0.0), (2**53 + 1, 1.0), (None, None)], "id long, x double")
    got = {r["column_name"]: r["cardinality"] for r in P.profile_columns(df).collect()}
    assert got == {"id": 2, "x": 2}


def test_empty_and_all_null_tables(spark):
    for rows in ([], [(None, None)]):
        df = spark.createDataFrame(rows, "x double, t string")
        assert P.profile_columns(df).count() == 2 and P.outlier_counts(df).count() == 0
        assert P.summary(df).first()["outlier_columns_count"] == 0
        assert {f["kind"] for f in P.quality_flags(df, "t", "classification").collect()} <= {"null_rate"}


def test_outliers_are_counted(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(100)] + [(1000.0, 1.0), (-1000.0, 1.0)], "x double, y double")
    got = {r["column_name"]: r["outliers"] for r in P.outliers_iqr(df).collect()}
    assert got == {"x": 2}
