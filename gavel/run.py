"""One governed run, composed from the operators (what a user of the library
writes): profile -> plan hints -> clean + gate (again with the next plan while
it fails and retries are left) -> stage table -> train the plan's candidates ->
leaderboard -> attributions of the winner -> fairness of its predictions ->
audit events. Every step is a Spark job over the table; the driver only keeps
small fitted parameters and decides which step comes next.

``decide`` appends a review decision and, where it ends the run, the final
outcome. ``retrain`` goes back to training on the stored cleaned stage, without
the rejected models. Both take the counters from the event log, so a run may be
continued by another driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.operators import evaluate as E
from gavel.operators import explain as X
from gavel.operators import fairness as FA
from gavel.operators import governance as G
from gavel.operators import plan_text as PT
from gavel.operators import profile as P
from gavel.operators import train as TR
from gavel.session import shared_path
from gavel.sources import events_io, io

ENTRY = "run_id string, input_pos int, model_name string, trained_successfully boolean, accuracy double, f1 double, auc_roc double, rmse double, mae double, r2 double, skip_reason string"
CANDIDATES = "plan_id long, run_id string, sensitive_attribute_candidates array<string>, sensitive_attributes array<string>, protected_attributes array<string>"


@dataclass
class RunResult:
    run_id: str
    target: str
    task: str
    keys: tuple[str, ...]
    root: str
    plan: dict
    attempts: int = 0
    quality_passed: bool = False
    report: dict = field(default_factory=dict)
    leaderboard: list[dict] = field(default_factory=list)
    selected: str | None = None
    top_features: list[dict] = field(default_factory=list)
    fairness: list[dict] = field(default_factory=list)
    fairness_passed: bool | None = None
    outcome: str | None = None

    @property
    def events_path(self) -> str:
        return f"{self.root}/events"


class EventLog:
    """Buffered appends to one run's events; the log gives their ids when they
    are committed, so several writers may append to one log."""

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id, self.rows = spark, path, run_id, []
        self.token = uuid.uuid4().hex

    def add(self, event_type: str, summary: str, details: dict, source: str = "automated") -> None:
        self.rows.append((self.run_id, len(self.rows), event_type, source, summary, json.dumps(details, default=str)))

    def flush(self) -> None:
        if self.rows:
            self.token = uuid.uuid4().hex
            events_io.commit_events(events_io.new_events(self.spark, self.rows), self.path, self.token)
        self.rows = []

    def outcome(self, status: str, retries: int, reroutes: int, **more) -> str:
        self.add("final_outcome", G.OUTCOME_TEXTS[status], {"status": status, "total_retries_used": retries, "total_human_reroutes_used": reroutes, **more})
        return status


def _plan_row(spark: SparkSession, run_id: str, raw: str) -> dict:
    v = PT.validate(spark.createDataFrame([(0, run_id, raw)], "plan_id long, run_id string, raw string")).first().asDict()
    if not v["valid"]:
        raise ValueError(f"invalid plan: {v['error']}")
    return v


def run_governed(
    spark: SparkSession,
    df: DataFrame,
    target: str,
    task: str,
    plan_texts: str | list[str],
    run_id: str,
    keys: tuple[str, ...] = (),
    root: str | None = None,
    **model_options,
) -> RunResult:
    """A whole run up to the review. ``plan_texts`` holds one plan per cleaning
    attempt: while the gate fails and retries are left, the next plan is tried
    (the last one again when there is no further)."""
    plan_texts = [plan_texts] if isinstance(plan_texts, str) else list(plan_texts)
    out = RunResult(run_id, target, task, tuple(keys), root or shared_path(spark, "runs"), {})
    log = EventLog(spark, out.events_path, run_id)
    cols = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column_name string, col_pos int")
    flags = [r["flag"] for r in P.quality_flags(df, target, task).orderBy("flag_pos").collect()]
    while True:
        out.plan = _plan_row(spark, run_id, plan_texts[min(out.attempts, len(plan_texts) - 1)])
        log.add("planner_run", f"Plan {out.attempts + 1}: {len(out.plan['recommended_models'] or [])} candidate models", {"plan": out.plan, "precomputed_quality_flags": flags})
        steps = spark.createDataFrame([(0, out.plan["recommended_preprocessing_steps"] or [])], "plan_id long, recommended_preprocessing_steps array<string>")
        hints = PT.step_hints(steps, cols).first()
        res = C.run(df, target, task, explicit_drop=list(hints["explicit_drop_columns"]), keys=tuple(keys),
                    smote=hints["smote_mentioned"], class_weight=hints["class_weight_mentioned"])
        # the stage table: the gate, training and re-training all read it
        io.save_stage(res.cleaned, out.root, run_id, "cleaned")
        cleaned = io.load_stage(spark, out.root, run_id, "cleaned")
        out.report = C.quality_report(df, cleaned, res.fit).first().asDict()
        out.quality_passed = bool(out.report["quality_check_passed"])
        res.fit.release()
        log.add("data_agent_run", f"Cleaning finished, gate {'passed' if out.quality_passed else 'failed'}", {"quality_report": out.report})
        if out.quality_passed:
            break
        if out.attempts >= G.MAX_RETRIES:
            out.outcome = log.outcome(G.OUTCOME_QUALITY_CAP, out.attempts, 0)
            log.flush()
            return out
        out.attempts += 1
    _train_and_audit(spark, out, cleaned, [], log, model_options)
    log.flush()
    return out


def retrain(spark: SparkSession, result: RunResult, **model_options) -> RunResult:
    """Train again on the run's stored cleaned table, without the models that
    the review rejected (read from the event log). Only a run whose newest event
    is a review that sends it back to training may be trained again."""
    events = events_io.read_events(spark, result.events_path).where(F.col("run_id") == result.run_id)
    typed = G.typed(events)
    state = G.run_state(typed).first()
    newest = G.enrich(typed).agg(F.max_by("review_route", "seq")).first()[0]
    if state is None or state["final_outcome"] is not None or newest != "back_to_training":
        raise ValueError(f"run {result.run_id!r} is not sent back to training")
    rejected = list(state["rejected_models"])
    log = EventLog(spark, result.events_path, result.run_id)
    cleaned = io.load_stage(spark, result.root, result.run_id, "cleaned")
    result.leaderboard, result.fairness, result.top_features = [], [], []
    result.selected = result.fairness_passed = None
    _train_and_audit(spark, result, cleaned, rejected, log, model_options)
    log.flush()
    return result


def _candidates(plan: dict, rejected: list[str]) -> list[str]:
    refused = {m.lower() for m in rejected}
    left = [m for m in (plan["recommended_models"] or []) if m.lower() not in refused]
    return left or [m for m in PT.KNOWN_MODELS if m.lower() not in refused]


def _train_and_audit(spark: SparkSession, out: RunResult, cleaned: DataFrame, rejected: list[str], log: EventLog, options: dict) -> None:
    target, task, run_id = out.target, out.task, out.run_id
    names = _candidates(out.plan, rejected)
    resolved = PT.resolve(spark.createDataFrame([(i, n, task) for i, n in enumerate(names)], "input_pos int, name string, task string")).orderBy("input_pos").collect()
    # the split hashes the key, or the whole row where there is none
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cleaned.columns]))
    keyed = cleaned.withColumn("__split", F.col(f"`{out.keys[0]}`").cast("string") if out.keys else whole)
    if task == "classification":
        split = TR.stratified_split(keyed, "__split", target).drop("__split")
        prepared = TR.prepare(split, target, out.keys, task, C.label_mapping(cleaned, target))
    else:
        prepared = TR.prepare(TR.with_split(keyed, "__split").drop("__split"), target, out.keys, task)
    # not kept: a pass scans the columns it needs of the stage table
    train, test = prepared.where(~F.col("is_test")), prepared.where(F.col("is_test"))
    entries, models = [], {}
    for r in resolved:
        if r["implementation"] is None:
            entries.append((run_id, r["input_pos"], r["name"], False, *[None] * 6, "no such model for this task"))
            continue
        try:  # a candidate that fails is recorded; the others go on
            model = TR.fit(train, r["implementation"], task, **options)
            p = TR.predictions(model, test, r["name"], task)
            m = (E.classification_metrics(p) if task == "classification" else E.regression_metrics(p)).first().asDict()
        except Exception as err:  # noqa: BLE001
            entries.append((run_id, r["input_pos"], r["name"], False, *[None] * 6, f"{type(err).__name__}: {err}"[:500]))
            continue
        models[r["name"]] = model
        entries.append((run_id, r["input_pos"], r["name"], True, m.get("accuracy"), m.get("f1"), m.get("auc_roc"), m.get("rmse"), m.get("mae"), m.get("r2"), None))
    board = spark.createDataFrame(entries, ENTRY)
    out.leaderboard = [r.asDict() for r in E.leaderboard(board, task).orderBy("rank").collect()]
    winners = [r["model_name"] for r in out.leaderboard if r["selected"]]
    if not winners:
        log.add("training_run", f"No candidate could be trained: {names}", {"error": "no model trained", "leaderboard": out.leaderboard})
        log.add("fairness_run", "Fairness skipped: there is no fitted model", {"error": "no fitted model", "overall_fairness_passed": False, "fairness_report": [], "attributes_skipped": []})
        out.fairness_passed = False
        return
    out.selected = winners[0]
    model = models[out.selected]
    feats = TR.feature_columns(cleaned, target, out.keys)
    importance = X.explain(spark, model, test, train, feats, f"{out.root}/models/{quote(run_id, safe='')}-{uuid.uuid4().hex}")
    out.top_features = [r.asDict() for r in X.top_features(importance, 5).collect()]
    log.add("training_run", f"Selected {out.selected} of {len(names)} candidates", {"leaderboard": out.leaderboard, "selected_model_name": out.selected, "shap_summary": out.top_features})
    cands = PT.sensitive_candidates(spark.createDataFrame([(0, run_id, out.plan["sensitive_attribute_candidates"], out.plan["sensitive_attributes"], out.plan["protected_attributes"])], CANDIDATES)).first()["candidates"]
    # predictions and groups come from the same rows
    scored = model.transform(prepared).select("row.*", F.col("prediction").cast("int").alias("__pred"))
    rep, overall, skipped = FA.audit(scored, list(cands), target, task, pred="__pred")
    out.fairness = [r.asDict() for r in rep.collect()]
    out.fairness_passed = bool(overall.first()["overall_fairness_passed"])
    log.add("fairness_run", f"Fairness of {len(out.fairness)} attributes, {'passed' if out.fairness_passed else 'violated'}",
            {"overall_fairness_passed": out.fairness_passed, "fairness_report": out.fairness, "attributes_skipped": [r["skipped_entry"] for r in skipped.collect()]})


def decide(spark: SparkSession, result: RunResult, decision: str, feedback: str = "") -> str:
    """Append a review decision and return the route that follows from the log
    (see ``governance.route_after_review_expr``). Where the run ends, the final
    outcome is appended as well."""
    log = EventLog(spark, result.events_path, result.run_id)
    log.add("human_decision", f"Review decision: {decision}", {"human_decision": decision, "human_feedback": feedback}, "human_reviewer")
    log.flush()
    events = events_io.read_committed(spark, result.events_path).where(F.col("run_id") == result.run_id)
    typed = G.typed(events)
    state = G.run_state(typed).first()
    if state["final_outcome"] is None:
        return G.enrich(typed).where(F.col("token") == log.token).first()["review_route"]
    if state["last_event_type"] != "final_outcome":
        log.outcome(state["final_outcome"], state["retry_count"], state["reroute_count"], selected_model=result.selected, overall_fairness_passed=result.fairness_passed)
        log.flush()
    result.outcome = state["final_outcome"]
    return "ended"
