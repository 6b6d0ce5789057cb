"""Plan-table queries (PLN-1..3, TRN-3/4) over the plan texts of the
planner events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import governance as G
from gavel.operators import plan_text as PT
from gavel.plans.q_gov import FOLD, RUN_EVENTS
from gavel.plans.registry import query
from gavel.plans.sql import GOV_COLUMNS
from gavel.sources import fixtures as fx

_names = "[" + ", ".join(f"'{n}'" for n in fx.PLAN_MODEL_NAMES) + "]"
PLAN_TEXTS = f"""pt0 AS (
  SELECT seq AS plan_id, run_id, seq % 10 AS shape,
         {_names}[seq % 9 + 1] AS m1, {_names}[(seq // 9) % 9 + 1] AS m2
  FROM run_events WHERE event_type = 'planner_run'),
pt1 AS (
  SELECT *,
         '{{"data_quality_concerns": ["High null rate in priority"], "recommended_preprocessing_steps": '
         || CASE shape WHEN 5 THEN '["Drop column priority", "Impute missing values"]'
                       WHEN 6 THEN '["Apply SMOTE oversampling"]'
                       WHEN 7 THEN '["Use class weight balancing"]'
                       WHEN 8 THEN '["Remove surnamed totals"]'
                       ELSE '["Impute missing values", "Scale numeric features"]' END
         || ', "recommended_models": '
         || CASE WHEN shape = 2 THEN '"' || m1 || '"' ELSE '["' || m1 || '", "' || m2 || '"]' END
         || ', "sensitive_attribute_candidates": '
         || CASE WHEN shape = 9 THEN '[], "protected_attributes": ["gender"]' ELSE '["gender", "region"]' END
         || CASE WHEN shape = 3 THEN '' ELSE ', "reasoning": "plan ' || CAST(plan_id AS VARCHAR) || '"' END
         || '}}' AS body
  FROM pt0),
plan_texts AS (
  SELECT plan_id, run_id,
         CASE WHEN shape = 1 THEN '  ```json' || chr(10) || body || chr(10) || '```  '
              WHEN shape = 4 THEN '{{"data_quality_concerns": ["x"], "recommended_models": ["' || m1 || '"'
              ELSE body END AS raw
  FROM pt1)"""

# Fixed values, kept apart from the operators' so that the oracle checks them.
_req = "['data_quality_concerns', 'reasoning', 'recommended_models', 'recommended_preprocessing_steps', 'sensitive_attribute_candidates']"
_REGISTRY = [
    ("logisticregression", "logistic", None), ("logistic", "logistic", None), ("randomforest", "random_forest", "random_forest"),
    ("xgboost", "gbt_deep", "gbt_deep"), ("gradientboosting", "gbt_shallow", "gbt_shallow"),
    ("ridge", None, "ridge"), ("lasso", None, "lasso"), ("svm", None, None),
]


def _lf(f: str) -> str:
    return (
        f"CASE WHEN ok AND json_type(b, '$.{f}') = 'ARRAY' THEN json_extract_string(b, '$.{f}[*]') "
        f"WHEN ok AND json_type(b, '$.{f}') = 'VARCHAR' THEN [json_extract_string(b, '$.{f}')] END"
    )


VALIDATED = f"""s0 AS (SELECT plan_id, run_id, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM plan_texts),
s1 AS (SELECT plan_id, run_id,
              CASE WHEN starts_with(t, '```')
                   THEN regexp_replace(regexp_replace(t, '^[^\\n]*(\\n|$)', ''), '(^|\\n)[ \\t]*```[ \\t]*$', '')
                   ELSE t END AS b
       FROM s0),
s2 AS (SELECT plan_id, run_id, json_valid(b) AND b <> '' AS parsed,
              CASE WHEN json_valid(b) AND b <> '' THEN b ELSE 'null' END AS jb FROM s1),
s3 AS (SELECT *, parsed AND json_type(jb) = 'OBJECT' AS ok, CASE WHEN json_type(jb) = 'OBJECT' THEN jb ELSE '{{}}' END AS b FROM s2),
s4 AS (SELECT *, CASE WHEN ok THEN list_sort(list_filter({_req}, lambda k: NOT list_contains(json_keys(b), k))) END AS missing FROM s3),
validated AS (
  SELECT plan_id, run_id,
         CASE WHEN NOT parsed THEN 'invalid JSON' WHEN NOT ok THEN 'plan is not a JSON object'
              WHEN len(missing) > 0 THEN 'missing required keys: ' || array_to_string(missing, ', ') END AS error,
         {_lf('data_quality_concerns')} AS data_quality_concerns,
         {_lf('recommended_preprocessing_steps')} AS recommended_preprocessing_steps,
         {_lf('recommended_models')} AS recommended_models,
         {_lf('sensitive_attribute_candidates')} AS sensitive_attribute_candidates,
         CASE WHEN ok THEN json_extract_string(b, '$.reasoning') END AS reasoning,
         {_lf('sensitive_attributes')} AS sensitive_attributes,
         {_lf('protected_attributes')} AS protected_attributes
  FROM s4),
vp AS (SELECT * FROM validated WHERE error IS NULL)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join([RUN_EVENTS, PLAN_TEXTS, VALIDATED, *ctes]) + "\n"


def _validated(spark, sf):
    return PT.validate(fx.plan_texts(spark, sf))


def _valid(spark, sf):
    return _validated(spark, sf).where("valid")


def _j(c: str, sep: str = " | "):
    return F.array_join(c, sep).alias(c)


# ---------------------------------------------------------------- PLN-1
@query(
    "plan_validate",
    W()
    + """SELECT plan_id, run_id, error IS NULL AS valid, error,
       array_to_string(data_quality_concerns, ' | ') AS data_quality_concerns,
       array_to_string(recommended_preprocessing_steps, ' | ') AS recommended_preprocessing_steps,
       array_to_string(recommended_models, ' | ') AS recommended_models,
       array_to_string(sensitive_attribute_candidates, ' | ') AS sensitive_attribute_candidates,
       reasoning FROM validated""",
)
def plan_validate(spark, sf):
    v = _validated(spark, sf)
    return v.select(
        "plan_id", "run_id", "valid", "error",
        *[_j(c) for c in PT.LIST_FIELDS], "reasoning",
    )


# ---------------------------------------------------------------- PLN-2
_cols_values = ", ".join(f"('{c}', {i})" for i, (c, *_r) in enumerate(GOV_COLUMNS))


@query(
    "plan_step_hints",
    W(
        f"cols(column_name, col_pos) AS (VALUES {_cols_values})",
        """st AS (SELECT plan_id, lower(coalesce(s, '')) AS sl FROM (SELECT plan_id, unnest(recommended_preprocessing_steps) AS s FROM vp)),
fl AS (SELECT vp.plan_id,
              coalesce(bool_or(contains(sl, 'smote') OR contains(sl, 'oversample') OR contains(sl, 'adasyn') OR contains(sl, 'oversampl')), false) AS smote_mentioned,
              coalesce(bool_or(contains(sl, 'class weight') OR contains(sl, 'class_weight')), false) AS class_weight_mentioned,
              coalesce(bool_or(contains(sl, 'frequency')), false) AS frequency_encoding_mentioned
       FROM vp LEFT JOIN st ON vp.plan_id = st.plan_id GROUP BY vp.plan_id),
dr AS (SELECT DISTINCT st.plan_id, cols.col_pos, cols.column_name FROM st JOIN cols ON contains(st.sl, lower(cols.column_name))
       WHERE contains(sl, 'drop') OR contains(sl, 'remove') OR contains(sl, 'exclude')),
dl AS (SELECT plan_id, string_agg(column_name, ', ' ORDER BY col_pos) AS cols FROM dr GROUP BY plan_id)""",
    )
    + """SELECT fl.plan_id, smote_mentioned, class_weight_mentioned, frequency_encoding_mentioned,
       coalesce(dl.cols, '') AS explicit_drop_columns
FROM fl LEFT JOIN dl ON fl.plan_id = dl.plan_id""",
)
def plan_step_hints(spark, sf):
    cols = fx.gov(spark, sf).columns
    cdf = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "column_name string, col_pos int")
    h = PT.step_hints(_valid(spark, sf), cdf)
    return h.select("plan_id", "smote_mentioned", "class_weight_mentioned", "frequency_encoding_mentioned", _j("explicit_drop_columns", ", "))


# ---------------------------------------------------------------- PLN-3
@query(
    "plan_sensitive_fallback",
    W()
    + """SELECT plan_id, run_id, array_to_string(coalesce(
         CASE WHEN len(sensitive_attribute_candidates) > 0 THEN sensitive_attribute_candidates END,
         CASE WHEN len(sensitive_attributes) > 0 THEN sensitive_attributes END,
         CASE WHEN len(protected_attributes) > 0 THEN protected_attributes END, []), ', ') AS candidates
FROM vp""",
)
def plan_sensitive_fallback(spark, sf):
    return PT.sensitive_candidates(_valid(spark, sf)).select("plan_id", "run_id", _j("candidates", ", "))


# ---------------------------------------------------------------- TRN-3
def _key_sql(n: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({n}, '{k}') THEN '{k}'" for k, _c, _r in _REGISTRY) + " END"


def _impl_sql(k: str, task: str) -> str:
    parts = []
    for key, clf, reg in _REGISTRY:
        c = f"'{clf}'" if clf else "NULL"
        r = f"'{reg}'" if reg else "NULL"
        parts.append(f"WHEN {k} = '{key}' THEN CASE WHEN {task} = 'classification' THEN {c} ELSE {r} END")
    return "CASE " + " ".join(parts) + " END"


@query(
    "model_resolve",
    W(
        """nm AS (SELECT plan_id, run_id, CAST(pos - 1 AS INTEGER) AS position, name, t.task
       FROM (SELECT plan_id, run_id, unnest(recommended_models) AS name, generate_subscripts(recommended_models, 1) AS pos FROM vp),
            (VALUES ('classification'), ('regression')) t(task)),
nk AS (SELECT *, """
        + _key_sql("regexp_replace(lower(name), '[-_ ]', '', 'g')")
        + """ AS matched_key FROM nm),
ni AS (SELECT *, """
        + _impl_sql("matched_key", "task")
        + """ AS implementation FROM nk)"""
    )
    + """SELECT plan_id, run_id, position, name, task, matched_key, implementation,
       CASE WHEN matched_key IS NULL THEN 'unknown model: ' || name
            WHEN implementation IS NULL THEN name || ': not for ' || task END AS skip_reason
FROM ni""",
)
def model_resolve(spark, sf):
    names = PT.model_names(_valid(spark, sf)).select("*", F.explode(F.array(F.lit("classification"), F.lit("regression"))).alias("task"))
    return PT.resolve(names).select("plan_id", "run_id", "position", "name", "task", "matched_key", "implementation", "skip_reason")


# ---------------------------------------------------------------- TRN-4
_known = "['LogisticRegression', 'RandomForest', 'XGBoost', 'GradientBoosting', 'Ridge', 'Lasso']"


@query(
    "model_exclusion",
    W(
        FOLD,
        f"""lp AS (SELECT run_id, arg_max(recommended_models, plan_id) AS models FROM vp GROUP BY run_id),
cand AS (SELECT run_id, CAST(generate_subscripts(models, 1) - 1 AS INTEGER) AS position, unnest(models) AS model FROM lp),
rej AS (SELECT DISTINCT run_id, lower(model) AS lm FROM rj),
kept AS (SELECT c.run_id, c.position, c.model, 'plan' AS source FROM cand c
         WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.run_id = c.run_id AND rej.lm = lower(c.model))),
emp AS (SELECT DISTINCT run_id FROM cand WHERE run_id NOT IN (SELECT run_id FROM kept)),
fb AS (SELECT e.run_id, CAST(k.i - 1 AS INTEGER) AS position, k.m AS model, 'fallback' AS source
       FROM emp e, (SELECT unnest({_known}) AS m, generate_subscripts({_known}, 1) AS i) k
       WHERE NOT EXISTS (SELECT 1 FROM rej WHERE rej.run_id = e.run_id AND rej.lm = lower(k.m)))""",
    )
    + "SELECT * FROM kept UNION ALL SELECT * FROM fb",
)
def model_exclusion(spark, sf):
    vp = _valid(spark, sf)
    latest = vp.groupBy("run_id").agg(F.max_by("recommended_models", "plan_id").alias("models"))
    cand = latest.select("run_id", F.posexplode("models").alias("position", "model"))
    state = G.run_state(G.typed(fx.run_events(spark, sf)))
    rejected = state.select("run_id", F.explode("rejected_models").alias("model"))
    return PT.exclude_rejected(cand, rejected)
