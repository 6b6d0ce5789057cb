"""Whole governed runs: plans by attempt, review, re-training, odd labels."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from gavel import run as R
from gavel.operators import governance as G
from gavel.session import shared_path
from gavel.sources import events_io, io
from gavel.sources import fixtures as fx


def plan(models, steps=(), sensitive=("gender", "region")):
    return json.dumps({"data_quality_concerns": [], "recommended_preprocessing_steps": list(steps), "recommended_models": list(models),
                       "sensitive_attribute_candidates": list(sensitive), "reasoning": "test"})


def root(spark):
    return shared_path(spark, "tests", f"run-{uuid.uuid4().hex}")


def log_of(spark, result):
    return events_io.read_events(spark, result.events_path).where(F.col("run_id") == result.run_id).orderBy("seq").collect()


def test_run_with_a_second_plan_review_and_retraining(spark, sf_small):
    plans = ["```json\n" + plan(["Logistic Regression"]) + "\n```", plan(["Logistic Regression", "SVM", "Random Forest"], ["Drop column priority"])]
    res = R.run_governed(spark, fx.gov_fixable(spark, sf_small), "income", "classification", plans, "01", keys=("order_id",), root=root(spark), max_depth=4)
    assert res.quality_passed and res.attempts == 1 and res.report["columns_dropped"] == ["priority"]
    assert [e["model_name"] for e in res.leaderboard][-1] == "SVM" and res.leaderboard[-1]["skip_reason"]
    assert res.selected in ("Logistic Regression", "Random Forest") and len(res.top_features) == 5
    assert {f["attribute"] for f in res.fairness} == {"gender", "region"}
    first = res.selected
    stage = io.load_stage(spark, res.root, "01", "cleaned").count()
    assert R.decide(spark, res, "reject_model_or_fairness") == "back_to_training"
    R.retrain(spark, res, max_depth=4)
    assert res.selected and res.selected != first and first not in [e["model_name"] for e in res.leaderboard]
    assert io.load_stage(spark, res.root, "01", "cleaned").count() == stage
    assert R.decide(spark, res, "approve") == "ended" and res.outcome == "APPROVED"
    with pytest.raises(ValueError):  # the run has ended
        R.retrain(spark, res)
    log = log_of(spark, res)
    assert [r.seq for r in log] == list(range(1, len(log) + 1))
    assert log[-1].event_type == "final_outcome" and sum(r.event_type == "final_outcome" for r in log) == 1
    assert G.audit_conformance(events_io.read_events(spark, res.events_path)).first()["conformant"]


def test_run_ends_when_every_plan_fails_the_gate(spark, sf_small):
    res = R.run_governed(spark, fx.gov_fixable(spark, sf_small), "income", "classification", plan(["Ridge"]), "r", keys=("order_id",), root=root(spark))
    assert not res.quality_passed and res.outcome == G.OUTCOME_QUALITY_CAP
    assert [r.event_type for r in log_of(spark, res)] == ["planner_run", "data_agent_run"] * 3 + ["final_outcome"]


def test_run_without_a_usable_model_skips_fairness(spark, sf_small):
    res = R.run_governed(spark, fx.gov(spark, sf_small), "income", "classification", plan(["SVM"]), "r", keys=("order_id",), root=root(spark))
    assert res.selected is None and res.fairness_passed is False
    assert [r.event_type for r in log_of(spark, res)][-2:] == ["training_run", "fairness_run"]
    assert R.decide(spark, res, "reject_model_or_fairness") == "back_to_training"


def test_labels_other_than_zero_and_one(spark):
    df = spark.range(600).selectExpr("cast(id % 7 as double) x", "cast(id % 11 as double) z", "if(id % 2 = 0, 'F', 'M') gender", "cast(if(id % 7 + id % 3 > 4, 2, 1) as int) y")
    res = R.run_governed(spark, df, "y", "classification", plan(["Logistic"], sensitive=["gender"]), "r", root=root(spark))
    assert res.leaderboard[0]["auc_roc"] > 0.8  # re-encoded, and no keys needed
    assert res.fairness[0]["attribute"] == "gender"


@pytest.mark.parametrize("model", ["Gradient Boosting", "Logistic"])
def test_three_classes(spark, model, monkeypatch):
    from gavel.operators import train as TR

    fit = TR.estimator
    monkeypatch.setattr(TR, "estimator", lambda impl, *a, **b: fit(impl, *a, **b) if impl != "gbt_shallow" else fit(impl, *a, **b).setClassifier(fit(impl, *a, **b).getClassifier().setMaxIter(3)))
    df = spark.range(300).selectExpr("cast(id % 9 as double) x", "cast(id % 5 as double) z", "concat('c', cast(id % 9 as int) div 3) y")
    res = R.run_governed(spark, df, "y", "classification", plan([model], sensitive=[]), "r", root=root(spark))
    assert res.leaderboard[0]["trained_successfully"] and res.leaderboard[0]["accuracy"] > 0.6 and res.top_features[0]["feature"] == "x"


def test_a_failing_candidate_does_not_end_the_run(spark, sf_small, monkeypatch):
    from gavel.operators import train as TR

    fit = TR.fit

    def broken(train, impl, task, **options):
        if impl == "random_forest":
            raise RuntimeError("out of luck")
        return fit(train, impl, task, **options)

    monkeypatch.setattr(TR, "fit", broken)
    res = R.run_governed(spark, fx.gov(spark, sf_small), "income", "classification", plan(["Random Forest", "Logistic"]), "r", keys=("order_id",), root=root(spark))
    assert res.selected == "Logistic" and "out of luck" in res.leaderboard[-1]["skip_reason"]


def test_regression_run(spark, sf_small):
    res = R.run_governed(spark, fx.gov(spark, sf_small), "total", "regression", plan(["Ridge", "Lasso"]), "r", keys=("order_id",), root=root(spark))
    assert res.leaderboard[0]["rmse"] <= res.leaderboard[1]["rmse"] and res.fairness == [] and res.fairness_passed


def test_a_run_and_its_report_keep_no_whole_rows(spark, sf_small, monkeypatch):
    """A kept partition is unrolled and read as a whole by one task."""
    from gavel.plans import QUERIES, q_model

    classic = type(spark.range(1))
    kept, persist = [], classic.persist
    monkeypatch.setattr(classic, "persist", lambda self, *a, **k: (kept.append(self.columns), persist(self, *a, **k))[1])
    assert q_model.fairness_run(spark, sf_small)[0].count() > 0
    assert QUERIES["train_ridge_gradient"](spark, sf_small).count() > 0
    res = R.run_governed(spark, fx.gov(spark, sf_small), "income", "classification", [plan(["Logistic Regression"])], "lean", keys=("order_id",), root=root(spark))
    assert res.selected and not [c for c in kept if "features" in c]
