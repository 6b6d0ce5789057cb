"""Cleaning on the fault tables (the reference's data-agent tests) and the
semantic traps of the cleaning rules on tiny frames."""

import math

from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.sources import fixtures as fx

KEYS = ("order_id",)


def _report(r):
    return r.report.first().asDict()


def test_failing_table_fails_gate(spark, sf_small):
    r = C.run(fx.gov_failing(spark, sf_small), "income", "classification", keys=KEYS)
    rep = _report(r)
    assert rep["quality_check_passed"] is False
    assert rep["rows_dropped_pct"] > 30
    assert set(rep["columns_dropped"]) == {"segment", "nation", "priority"}
    # no nulls left in the cleaned table
    nulls = r.cleaned.select([F.sum(F.col(f"`{c}`").isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(r.cleaned.columns)]).first()
    assert sum(nulls) == 0
    assert r.cleaned.where(~F.col("income").isin(0, 1)).count() == 0


def test_fixable_table_passes_after_plan_drop(spark, sf_small):
    df = fx.gov_fixable(spark, sf_small)
    first = _report(C.run(df, "income", "classification", keys=KEYS))
    assert first["quality_check_passed"] is False
    assert first["unhandled_high_null_columns"][0].startswith("priority (42")
    second = C.run(df, "income", "classification", explicit_drop=["priority"], keys=KEYS)
    rep = _report(second)
    assert rep["quality_check_passed"] is True
    assert rep["columns_dropped"] == ["priority"]
    acts = [(r["step"], r["column_name"], r["detail"]) for r in second.actions.collect()]
    assert ("drop_column", "priority", "named by the plan") in acts


def test_clean_table_passes(spark, sf_small):
    rep = _report(C.run(fx.gov_clean(spark, sf_small), "income", "classification", keys=KEYS))
    assert rep["quality_check_passed"] is True
    assert rep["missing_pct_after_cleaning"] == 0.0
    assert rep["class_balance_ratio"] > 1.5


def test_mode_tie_takes_smallest_and_median_is_exact(spark):
    df = spark.createDataFrame(
        [(1, "b", 1.0, "y"), (2, "a", None, "y"), (3, None, 4.0, "n"), (4, "b", 10.0, "n"), (5, "a", 2.0, "y")],
        "k long, cat string, x double, t string",
    )
    f = C.fit(df, "t", "classification", keys=("k",))
    assert f.impute_mode["cat"] == ("a", 1)
    assert f.impute_numeric["x"] == (3.0, 1)  # median of 1, 2, 4, 10


def test_boolean_with_nulls_is_categorical_and_one_hot(spark):
    df = spark.createDataFrame([(1, True, "a"), (2, None, "b"), (3, False, "a"), (4, True, "b")], "k long, flag boolean, t string")
    out = C.run(df, "t", "classification", keys=("k",)).cleaned
    assert "flag_True" in out.columns and "flag_False" in out.columns and "flag" not in out.columns


def test_boolean_without_nulls_is_untouched(spark):
    df = spark.createDataFrame([(1, True, "a"), (2, False, "b")], "k long, flag boolean, t string")
    out = C.run(df, "t", "classification", keys=("k",)).cleaned
    assert dict(out.dtypes)["flag"] == "boolean"


def test_all_null_category_after_row_drop_stays_null(spark):
    # half the rows null (kept: the drop rule is > 50 %), all null once the
    # rows without a target are gone
    df = spark.createDataFrame(
        [(1, None, "a"), (2, None, "b"), (3, "z", None), (4, "y", None)],
        "k long, c string, t string",
    )
    r = C.run(df, "t", "classification", keys=("k",))
    assert [a["column_name"] for a in r.actions.collect() if a["detail"].startswith("unresolved")] == ["c"]
    # no values -> no one-hot columns; the column itself is gone
    assert not [c for c in r.cleaned.columns if c.startswith("c")]


def test_standard_scale_uses_population_std_and_constant_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = C.standard_scale(df, ["x", "c"]).collect()
    assert math.isclose(out[0]["x"], -1.0 / math.sqrt(2.0 / 3.0))
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]


def test_explicit_drop_substring_trap(spark):
    from gavel.operators import plan_text as PT

    plans = spark.createDataFrame([(1, "r", ["Remove surnamed totals", "Impute"])], "plan_id long, run_id string, recommended_preprocessing_steps array<string>")
    cols = spark.createDataFrame([("total", 0), ("age", 1), ("name", 2)], "column_name string, col_pos int")
    h = PT.step_hints(plans, cols).first()
    assert h["explicit_drop_columns"] == ["total", "name"]  # 'surnamed' holds 'name'


def test_boolean_target_stays_boolean(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, None, False), (3, 5.0, True)], "k long, x double, t boolean")
    r = C.run(df, "t", "classification", keys=("k",))
    assert dict(r.cleaned.dtypes)["t"] == "boolean" and [x.t for x in r.cleaned.orderBy("k").collect()] == [True, False, True]


def test_many_classes_are_encoded(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.rand(1).alias("x"), F.format_string("c%05d", 2999 - F.col("id")).alias("t"))
    got = {r.k: r.t for r in C.run(df, "t", "classification", keys=("k",)).cleaned.collect()}
    assert got == {k: 2999 - k for k in range(3000)}


def test_nested_columns_are_refused_by_name(spark):
    import pytest

    df = spark.createDataFrame([(1, [1], "a")], "k long, list array<int>, t string")
    with pytest.raises(ValueError, match="list"):
        C.fit(df, "t", "classification", keys=("k",))


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, "b"), (3, 4.0, "a")], "k long, x double, t string")
    f = C.fit(df, "t", "classification", keys=("k",))
    assert f.impute_numeric["x"] == (3.0, 1)


def test_imputed_rows_take_the_share_of_the_mode(spark):
    rows = [(i, f"v{i % 35}" if i % 3 else None, "a" if i % 2 else "b") for i in range(240)] + [(i, "v1", "a") for i in range(240, 300)]
    df = spark.createDataFrame(rows, "k long, c string, t string")
    r = C.run(df, "t", "classification", keys=("k",))
    assert "c" in r.fit.freq and r.cleaned.where("c is null").count() == 0
    by = {x.k: x.c for x in r.cleaned.collect()}
    assert by[0] == by[240]  # an imputed row has the mode's code


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, x double, c string, t string")
    r = C.run(df, "t", "classification", keys=("k",))
    assert r.cleaned.count() == 0 and r.report.first()["rows_dropped"] == 0
