"""Run-event governance queries (GOV-1..9, SRC-5/6) over the event log
derived from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import governance as G
from gavel.session import shared_path
from gavel.sources import events_io
from gavel.sources import fixtures as fx

RUN_EVENTS = """ev0 AS (
  SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'planner_run' WHEN 'signup' THEN 'data_agent_run'
              WHEN 'click' THEN 'training_run' WHEN 'error' THEN 'fairness_run'
              WHEN 'purchase' THEN 'human_decision' END AS event_type
  FROM events),
ev1 AS (
  SELECT run_id, seq, ts, event_type,
         CASE WHEN event_type = 'human_decision' THEN 'human_reviewer' ELSE 'automated' END AS event_source,
         CASE WHEN event_type = 'data_agent_run' THEN seq % 4 <> 0 END AS quality_passed,
         CASE WHEN event_type = 'human_decision' THEN ['approve', 'reject_data_quality', 'reject_model_or_fairness'][seq % 3 + 1] END AS decision,
         CASE WHEN event_type = 'training_run' THEN ['LogisticRegression', 'RandomForest', 'GradientBoosting'][seq % 3 + 1] END AS model
  FROM ev0),
run_events AS (
  SELECT * REPLACE (CASE WHEN seq % 50 <> 0 THEN quality_passed END AS quality_passed,
                    CASE WHEN seq % 50 <> 0 THEN decision END AS decision,
                    CASE WHEN seq % 50 <> 0 THEN model END AS model),
         'event ' || CAST(seq AS VARCHAR) || ': ' || replace(event_type, '_', ' ') AS summary,
         CASE WHEN seq % 50 = 0 THEN 'bad'
              WHEN quality_passed IS NOT NULL THEN '{"quality_report":{"quality_check_passed":' || CAST(quality_passed AS VARCHAR) || '}}'
              WHEN decision IS NOT NULL THEN '{"human_decision":"' || decision || '"}'
              WHEN model IS NOT NULL THEN '{"selected_model_name":"' || model || '"}'
              ELSE '{"event_type":"' || event_type || '"}' END AS details
  FROM ev1)"""

FOLD = """enr AS (
  SELECT *,
         (event_type = 'data_agent_run' AND coalesce(quality_passed, true) = false) AS is_failed,
         coalesce(event_type = 'human_decision' AND decision IN ('reject_data_quality', 'reject_model_or_fairness'), false) AS is_rej
  FROM run_events),
enr1 AS (
  SELECT *,
         sum(CAST(is_failed AS INTEGER)) OVER w AS cum_failed,
         sum(CAST(is_rej AS INTEGER)) OVER w AS cum_rejected
  FROM enr WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
enr2 AS (
  SELECT *,
         CAST(least(cum_failed - CAST(is_failed AS INTEGER), 2) AS BIGINT) AS retry_before,
         CAST(least(cum_rejected - CAST(is_rej AS INTEGER), 2) AS BIGINT) AS reroute_before
  FROM enr1),
enr3 AS (
  SELECT *,
         CASE WHEN event_type = 'data_agent_run' THEN
           CASE WHEN coalesce(quality_passed, true) THEN 'train' WHEN retry_before < 2 THEN 'replan' ELSE 'quality_cap' END END AS cleaning_route,
         CASE WHEN event_type = 'human_decision' THEN
           CASE WHEN decision = 'approve' THEN 'finish' WHEN reroute_before >= 2 THEN 'review_cap'
                WHEN decision = 'reject_data_quality' THEN 'back_to_plan'
                WHEN decision = 'reject_model_or_fairness' THEN 'back_to_training' ELSE 'finish' END END AS review_route
  FROM enr2),
enr4 AS (
  SELECT *,
         CASE WHEN event_type = 'final_outcome' THEN json_extract_string(details, '$.status')
              WHEN cleaning_route = 'quality_cap' THEN 'DATA_QUALITY_CAP_REACHED'
              WHEN review_route = 'review_cap' THEN 'HUMAN_REJECTION_CAP_REACHED'
              WHEN review_route = 'finish' THEN 'APPROVED' END AS outcome
  FROM enr3),
term AS (SELECT run_id, min(seq) AS t FROM enr4 WHERE outcome IS NOT NULL GROUP BY run_id),
eff AS (SELECT e.* FROM enr4 e LEFT JOIN term ON e.run_id = term.run_id WHERE term.t IS NULL OR e.seq <= term.t),
lm AS (
  SELECT *, (last_value(CASE WHEN event_type = 'training_run' THEN {'m': model} END IGNORE NULLS)
              OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).m AS last_model
  FROM eff),
rj AS (SELECT run_id, last_model AS model, min(seq) AS fs FROM lm
       WHERE review_route = 'back_to_training' AND last_model IS NOT NULL
       GROUP BY run_id, last_model),
rjl AS (SELECT run_id, string_agg(model, ', ' ORDER BY fs) AS rejected_models FROM rj GROUP BY run_id),
st0 AS (
  SELECT run_id, count(*) AS n_events, count_if(is_failed) AS failed_checks, count_if(is_rej) AS rejections,
         -- in a struct: arg_max skips NULL arguments, but the newest review counts even if unreadable
         arg_max({'d': decision}, CASE WHEN event_type = 'human_decision' THEN seq END).d AS last_decision,
         arg_max(CASE WHEN cleaning_route = 'replan' THEN 'data_agent' WHEN review_route = 'back_to_plan' THEN 'human_reviewer' END,
                 CASE WHEN cleaning_route = 'replan' OR review_route = 'back_to_plan' THEN seq END) AS last_failure_source,
         arg_max(outcome, CASE WHEN outcome IS NOT NULL THEN seq END) AS final_outcome,
         max(CASE WHEN outcome IS NOT NULL THEN seq END) AS terminal_seq,
         arg_max(event_type, seq) AS last_event_type,
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM eff GROUP BY run_id),
st AS (
  SELECT st0.*, CAST(least(failed_checks, 2) AS BIGINT) AS retry_count, CAST(least(rejections, 2) AS BIGINT) AS reroute_count,
         coalesce(final_outcome = 'DATA_QUALITY_CAP_REACHED', false) AS unresolved_quality_issue,
         coalesce(final_outcome = 'HUMAN_REJECTION_CAP_REACHED', false) AS unresolved_human_rejection,
         coalesce(rjl.rejected_models, '') AS rejected_models
  FROM st0 LEFT JOIN rjl ON st0.run_id = rjl.run_id)"""


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join([RUN_EVENTS, *ctes]) + "\n"


STATE_SQL = W(FOLD) + f"""SELECT run_id, n_events, failed_checks, rejections, retry_count, reroute_count, unresolved_quality_issue,
       unresolved_human_rejection, last_decision, last_failure_source, final_outcome, terminal_seq, last_event_type,
       {iso('first_ts')} AS first_ts, {iso('last_ts')} AS last_ts, rejected_models FROM st"""


def _state_out(st: DataFrame) -> DataFrame:
    return st.select(
        "run_id", "n_events", "failed_checks", "rejections", "retry_count", "reroute_count",
        "unresolved_quality_issue", "unresolved_human_rejection", "last_decision", "last_failure_source",
        "final_outcome", "terminal_seq", "last_event_type",
        G.iso_ts(F.col("first_ts")).alias("first_ts"), G.iso_ts(F.col("last_ts")).alias("last_ts"),
        F.array_join("rejected_models", ", ").alias("rejected_models"),
    )


def _query(name, sql):
    from gavel.plans.registry import query

    return query(name, sql)


# ---------------------------------------------------------------- GOV-1
@_query(
    "route_after_cleaning",
    W(FOLD) + "SELECT run_id, seq, coalesce(CAST(quality_passed AS VARCHAR), 'unknown') AS quality_passed, retry_before AS retry_count_before, cleaning_route AS route FROM enr4 WHERE event_type = 'data_agent_run'",
)
def route_after_cleaning(spark, sf):
    e = G.enrich(G.typed(fx.run_events(spark, sf)))
    return e.where(F.col("event_type") == "data_agent_run").select(
        "run_id", "seq", F.coalesce(F.col("quality_passed").cast("string"), F.lit("unknown")).alias("quality_passed"), "retry_count_before", F.col("cleaning_route").alias("route")
    )


# ---------------------------------------------------------------- GOV-2
@_query(
    "route_after_review",
    W(FOLD)
    + """SELECT run_id, seq, decision, reroute_before AS reroute_count_before, review_route AS route,
       coalesce(decision NOT IN ('approve', 'reject_data_quality', 'reject_model_or_fairness'), true) AS unrecognised
FROM enr4 WHERE event_type = 'human_decision'""",
)
def route_after_review(spark, sf):
    e = G.enrich(G.typed(fx.run_events(spark, sf)))
    return e.where(F.col("event_type") == "human_decision").select(
        "run_id", "seq", "decision", "reroute_count_before", F.col("review_route").alias("route"),
        G.unrecognised(F.col("decision")).alias("unrecognised"),
    )


# ---------------------------------------------------------------- GOV-3
@_query("run_state", STATE_SQL)
def run_state(spark, sf):
    return _state_out(G.run_state(G.typed(fx.run_events(spark, sf))))


# ---------------------------------------------------------------- GOV-4
@_query(
    "run_status",
    W(FOLD)
    + """SELECT run_id,
       CASE WHEN final_outcome IS NOT NULL THEN 'completed' WHEN last_event_type = 'fairness_run' THEN 'paused' ELSE 'running' END AS status,
       final_outcome, retry_count, reroute_count, unresolved_quality_issue, unresolved_human_rejection, last_decision
FROM st""",
)
def run_status(spark, sf):
    return G.run_status(G.run_state(G.typed(fx.run_events(spark, sf))))


# ---------------------------------------------------------------- GOV-5
@_query(
    "review_payload",
    W(FOLD)
    + """SELECT run_id,
       arg_max(details, CASE WHEN event_type = 'planner_run' THEN seq END) AS plan_details,
       arg_max(details, CASE WHEN event_type = 'data_agent_run' THEN seq END) AS cleaning_details,
       arg_max(details, CASE WHEN event_type = 'training_run' THEN seq END) AS training_details,
       arg_max(details, CASE WHEN event_type = 'fairness_run' THEN seq END) AS fairness_details
FROM eff GROUP BY run_id""",
)
def review_payload(spark, sf):
    return G.review_payload(G.typed(fx.run_events(spark, sf)))


# ---------------------------------------------------------------- SRC-6
_parsed = "CASE WHEN try_cast(details AS JSON) IS NULL THEN CAST(json_object('raw', details) AS VARCHAR) ELSE details END"


@_query(
    "audit_trail",
    W() + f"SELECT seq AS id, run_id, {iso('ts')} AS timestamp, event_type, event_source, summary, {_parsed} AS details FROM run_events",
)
def audit_trail(spark, sf):
    return G.audit_trail(fx.run_events(spark, sf))


# ---------------------------------------------------------------- GOV-8
@_query(
    "audit_view",
    W()
    + f"""SELECT run_id, seq AS id, {iso('ts')} AS timestamp_utc,
       CASE WHEN event_source = 'human_reviewer' THEN 'reviewer' ELSE 'system: ' || event_source END AS source,
       event_type, summary, count(*) OVER (PARTITION BY run_id) AS total_events
FROM run_events""",
)
def audit_view(spark, sf):
    return G.audit_view(fx.run_events(spark, sf))


# ---------------------------------------------------------------- SRC-5, GOV-9
_OUTCOMES = """outcomes AS (
  SELECT run_id, (SELECT max(seq) FROM run_events) + 1 + terminal_seq AS seq, last_ts AS ts,
         'final_outcome' AS event_type, 'automated' AS event_source,
         CASE final_outcome WHEN 'APPROVED' THEN 'Run ended: approved in review'
              WHEN 'DATA_QUALITY_CAP_REACHED' THEN 'Run ended: cleaning failed the gate on every attempt'
              ELSE 'Run ended: rejected in review too often' END AS summary,
         '{"status":"' || final_outcome || '","total_retries_used":' || CAST(retry_count AS VARCHAR)
           || ',"total_human_reroutes_used":' || CAST(reroute_count AS VARCHAR) || '}' AS details
  FROM st WHERE final_outcome IS NOT NULL)"""


def appended_log(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Append the derived final-outcome events to a fresh event table in the
    shared folder and read the whole table back."""
    ev = fx.run_events(spark, sf)
    out = G.outcome_events(G.run_state(G.typed(ev)), ev)
    path = shared_path(spark, "audit", f"outcomes-{uuid.uuid4().hex}")
    base = ev.select("run_id", "seq", "ts", "event_type", "event_source", "summary", "details")
    events_io.append_events(base, path)
    events_io.append_events(out, path)
    return events_io.read_events(spark, path), out


@_query(
    "audit_append",
    W(FOLD, _OUTCOMES) + f"SELECT run_id, seq, {iso('ts')} AS ts, event_type, event_source, summary, details FROM outcomes",
)
def audit_append(spark, sf):
    log, _ = appended_log(spark, sf)
    return log.where(F.col("event_type") == "final_outcome").select(
        "run_id", "seq", G.iso_ts(F.col("ts")).alias("ts"), "event_type", "event_source", "summary", "details"
    )


@_query(
    "audit_conformance",
    W(FOLD, _OUTCOMES)
    + """, full_log AS (SELECT run_id, seq, ts, event_type, event_source FROM run_events
                  UNION ALL SELECT run_id, seq, ts, event_type, event_source FROM outcomes),
lg AS (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY seq) AS prev_ts FROM full_log),
per AS (SELECT run_id, count(*) AS n_events,
               bool_and(prev_ts IS NULL OR prev_ts <= ts) AS time_ordered,
               bool_and((event_source = 'human_reviewer') = (event_type = 'human_decision')) AS sources_ok,
               arg_max(event_type, seq) AS last_type,
               list(DISTINCT event_type) AS types
        FROM lg GROUP BY run_id),
per2 AS (SELECT *, list_sort(list_filter(['planner_run', 'data_agent_run', 'training_run', 'fairness_run', 'human_decision', 'final_outcome'],
                                         lambda t: NOT list_contains(types, t))) AS missing FROM per)
SELECT run_id, n_events, time_ordered, sources_ok, array_to_string(missing, ', ') AS missing_types,
       last_type = 'final_outcome' AS ends_with_outcome,
       n_events >= 5 AND time_ordered AND sources_ok AND len(missing) = 0 AND last_type = 'final_outcome' AS conformant
FROM per2""",
)
def audit_conformance(spark, sf):
    log, _ = appended_log(spark, sf)
    c = G.audit_conformance(log)
    return c.withColumn("missing_types", F.array_join("missing_types", ", "))


# ---------------------------------------------------------------- GOV-9 over a run's own trail
_PLANS = [
    '{"data_quality_concerns": [], "recommended_preprocessing_steps": ["Impute"], "recommended_models": ["Logistic"], "sensitive_attribute_candidates": ["gender"], "reasoning": "first"}',
    '{"data_quality_concerns": [], "recommended_preprocessing_steps": ["Drop column priority"], "recommended_models": ["SVM", "Logistic"], "sensitive_attribute_candidates": ["gender"], "reasoning": "second"}',
]


@_query(
    "run_trail_conformance",
    """SELECT * FROM (VALUES
  (1::BIGINT, 'planner_run', 'automated'), (2, 'data_agent_run', 'automated'), (3, 'planner_run', 'automated'), (4, 'data_agent_run', 'automated'),
  (5, 'training_run', 'automated'), (6, 'fairness_run', 'automated'), (7, 'human_decision', 'human_reviewer'),
  (8, 'training_run', 'automated'), (9, 'fairness_run', 'automated'), (10, 'human_decision', 'human_reviewer'), (11, 'final_outcome', 'automated'))
  t(seq, event_type, event_source), (SELECT true AS conformant FROM orders HAVING count(*) > 0) c""",
)
def run_trail_conformance(spark, sf):
    """A run over the fixable table: the gate fails, the second plan passes, the
    review sends it back to training once and then approves."""
    from gavel import run as R

    root = shared_path(spark, "runs", uuid.uuid4().hex)
    result = R.run_governed(spark, fx.gov_fixable(spark, sf), "income", "classification", _PLANS, "run/1", keys=("order_id",), root=root)
    if R.decide(spark, result, "reject_model_or_fairness") != "back_to_training":
        raise RuntimeError("a rejected model must lead back to training")
    R.decide(spark, R.retrain(spark, result), "approve")
    log = events_io.read_events(spark, result.events_path)
    ok = G.audit_conformance(log).select("run_id", "conformant")
    return log.join(ok, "run_id").select("seq", "event_type", "event_source", "conformant")
