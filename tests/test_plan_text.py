"""Plan-text validation edge cases and model-name resolution."""

from gavel.operators import plan_text as PT

VALID = '{"data_quality_concerns": [], "recommended_preprocessing_steps": ["a"], "recommended_models": ["XGBoost"], "sensitive_attribute_candidates": ["sex"], "reasoning": "r"}'


def test_validate_shapes(spark):
    rows = [
        (1, "r", VALID),
        (2, "r", "```json\n" + VALID + "\n```"),
        (3, "r", VALID.replace('["XGBoost"]', '"XGBoost"')),
        (4, "r", VALID.replace(', "reasoning": "r"', "")),
        (5, "r", "{broken"),
        (6, "r", "[1, 2]"),
    ]
    df = spark.createDataFrame(rows, "plan_id long, run_id string, raw string")
    out = {r["plan_id"]: r for r in PT.validate(df).collect()}
    assert out[1]["valid"] and out[2]["valid"] and out[2]["recommended_models"] == ["XGBoost"]
    assert out[3]["valid"] and out[3]["recommended_models"] == ["XGBoost"]
    assert out[4]["error"] == "missing required keys: reasoning"
    assert out[5]["error"] == "invalid JSON"
    assert out[6]["error"] == "plan is not a JSON object"


def test_resolve(spark):
    names = spark.createDataFrame(
        [("Logistic Regression", "classification"), ("ridge-regression", "classification"), ("SVM", "classification"), ("Neural Net", "regression"), ("xgb-oost", "regression")],
        "name string, task string",
    )
    out = {r["name"]: (r["matched_key"], r["implementation"], r["skip_reason"]) for r in PT.resolve(names).collect()}
    assert out["Logistic Regression"] == ("logisticregression", "logistic", None)
    assert out["ridge-regression"][2] == "ridge-regression: not for classification"
    assert out["SVM"][2] == "SVM: not for classification"
    assert out["Neural Net"][2] == "unknown model: Neural Net"
    assert out["xgb-oost"][:2] == ("xgboost", "gbt_deep")


def test_exclusion_fallback(spark):
    cand = spark.createDataFrame([("a", 0, "XGBoost"), ("b", 0, "Ridge"), ("b", 1, "Lasso")], "run_id string, position int, model string")
    rej = spark.createDataFrame([("a", "xgboost"), ("b", "LASSO")], "run_id string, model string")
    out = sorted((r["run_id"], r["model"], r["source"]) for r in PT.exclude_rejected(cand, rej).collect())
    assert ("b", "Ridge", "plan") in out and ("b", "Lasso", "plan") not in out
    assert [m for r, m, s in out if r == "a"] == sorted(["LogisticRegression", "RandomForest", "GradientBoosting", "Ridge", "Lasso"])
