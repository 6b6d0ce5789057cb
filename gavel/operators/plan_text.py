"""Plan tables: parse and validate raw plan texts (PLN-1), keyword hints of
the preprocessing steps (PLN-2), sensitive-candidate fallbacks (PLN-3), model
name resolution (TRN-3) and candidate exclusion (TRN-4).

All of it runs as batch operators over a table of plans (one row per plan),
so that any number of runs is handled by one job. JSON handling stays
JVM-side (``try_parse_json`` / ``try_variant_get`` / ``json_object_keys``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.exprs import contains_any

# Keys every plan must hold, and its list-valued fields.
REQUIRED_KEYS = [
    "data_quality_concerns",
    "reasoning",
    "recommended_models",
    "recommended_preprocessing_steps",
    "sensitive_attribute_candidates",
]
LIST_FIELDS = [
    "data_quality_concerns",
    "recommended_preprocessing_steps",
    "recommended_models",
    "sensitive_attribute_candidates",
]

# Step keywords.
SMOTE_WORDS = ["smote", "oversample", "adasyn", "oversampl"]
CLASS_WEIGHT_WORDS = ["class weight", "class_weight"]
FREQUENCY_WORD = "frequency"
DROP_WORDS = ["drop", "remove", "exclude"]

# Model registry, in lookup order: key -> (classification
# implementation, regression implementation); None = not available.
REGISTRY = [
    ("logisticregression", "logistic", None),
    ("logistic", "logistic", None),
    ("randomforest", "random_forest", "random_forest"),
    ("xgboost", "gbt_deep", "gbt_deep"),
    ("gradientboosting", "gbt_shallow", "gbt_shallow"),
    ("ridge", None, "ridge"),
    ("lasso", None, "lasso"),
    ("svm", None, None),
]
KNOWN_MODELS = ["LogisticRegression", "RandomForest", "XGBoost", "GradientBoosting", "Ridge", "Lasso"]


def _strip_fences(raw: Column) -> Column:
    """Trim whitespace; a leading fence line and a closing fence are dropped."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    no_first = F.regexp_replace(t, r"^[^\n]*(\n|$)", "")
    no_last = F.regexp_replace(no_first, r"(^|\n)[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(t, F.lit("```")), no_last).otherwise(t)


def _list_field(v: Column, name: str) -> Column:
    """Array of strings; a plain string becomes a one-element list."""
    as_list = F.try_variant_get(v, f"$.{name}", "array<string>")
    as_text = F.when(
        F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING",
        F.array(F.try_variant_get(v, f"$.{name}", "string")),
    )
    return F.coalesce(as_list, as_text)


def validate(plans: DataFrame) -> DataFrame:
    """PLN-1: (plan_id, run_id, valid, error, <list fields>, reasoning,
    sensitive_attributes, protected_attributes)."""
    body = _strip_fences(F.col("raw"))
    p = plans.select("plan_id", "run_id", body.alias("__body"))
    p = p.select("*", F.try_parse_json("__body").alias("__v"), F.json_object_keys("__body").alias("__keys"))
    is_obj = F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.coalesce(F.col("__keys"), F.array().cast("array<string>"))))
    error = (
        F.when(F.col("__v").isNull(), F.lit("invalid JSON"))
        .when(~is_obj, F.lit("plan is not a JSON object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required keys: "), F.array_join(missing, ", ")))
    )
    out = p.select(
        "plan_id",
        "run_id",
        error.isNull().alias("valid"),
        error.alias("error"),
        *[_list_field(F.col("__v"), f).alias(f) for f in LIST_FIELDS],
        F.try_variant_get("__v", "$.reasoning", "string").alias("reasoning"),
        _list_field(F.col("__v"), "sensitive_attributes").alias("sensitive_attributes"),
        _list_field(F.col("__v"), "protected_attributes").alias("protected_attributes"),
    )
    return out


def step_hints(valid_plans: DataFrame, columns: DataFrame) -> DataFrame:
    """PLN-2: (plan_id, smote_mentioned, class_weight_mentioned,
    frequency_encoding_mentioned, explicit_drop_columns).

    Steps are exploded (a few per plan); the drop match is a nested-loop
    join of drop-steps with the table's column names - the column list is
    the schema of one table, so it is broadcast."""
    steps = valid_plans.select("plan_id", F.posexplode_outer("recommended_preprocessing_steps").alias("pos", "step"))
    steps = steps.withColumn("sl", F.lower(F.coalesce(F.col("step"), F.lit(""))))
    flags = steps.groupBy("plan_id").agg(
        F.coalesce(F.bool_or(contains_any(F.col("sl"), SMOTE_WORDS)), F.lit(False)).alias("smote_mentioned"),
        F.coalesce(F.bool_or(contains_any(F.col("sl"), CLASS_WEIGHT_WORDS)), F.lit(False)).alias("class_weight_mentioned"),
        F.coalesce(F.bool_or(F.contains(F.col("sl"), F.lit(FREQUENCY_WORD))), F.lit(False)).alias("frequency_encoding_mentioned"),
    )
    drop_steps = steps.where(contains_any(F.col("sl"), DROP_WORDS))
    cols = F.broadcast(columns.select("column_name", "col_pos"))
    hits = drop_steps.join(cols, F.contains(F.col("sl"), F.lower(F.col("column_name"))))
    hits = hits.select("plan_id", "col_pos", "column_name").distinct()
    drops = hits.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("col_pos", "column_name"))).alias("__d"))
    drops = drops.select("plan_id", F.transform("__d", lambda s: s["column_name"]).alias("explicit_drop_columns"))
    return flags.join(drops, "plan_id", "left").withColumn(
        "explicit_drop_columns", F.coalesce(F.col("explicit_drop_columns"), F.array().cast("array<string>"))
    )


def sensitive_candidates(valid_plans: DataFrame) -> DataFrame:
    """PLN-3: first non-empty of sensitive_attribute_candidates,
    sensitive_attributes, protected_attributes; else empty."""
    empty = F.array().cast("array<string>")

    def non_empty(c: str) -> Column:
        return F.when(F.size(F.col(c)) > 0, F.col(c))

    return valid_plans.select(
        "plan_id",
        "run_id",
        F.coalesce(non_empty("sensitive_attribute_candidates"), non_empty("sensitive_attributes"), non_empty("protected_attributes"), empty).alias("candidates"),
    )


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_ ]", "")


def registry_key(name: Column) -> Column:
    """First registry key (in order) that is a substring of the normalised
    name: a CASE chain, so resolution is a projection (no join)."""
    n = normalised_name(name)
    out = None
    for key, _c, _r in REGISTRY:
        cond = F.contains(n, F.lit(key))
        out = F.when(cond, F.lit(key)) if out is None else out.when(cond, F.lit(key))
    return out


def _impl(key: Column, task: Column) -> Column:
    out = None
    for k, clf, reg in REGISTRY:
        v = F.when(task == "classification", F.lit(clf)).otherwise(F.lit(reg))
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def resolve(names: DataFrame) -> DataFrame:
    """TRN-3 over (..., name, task): matched registry key and our
    implementation, or the reason the name is skipped."""
    key = registry_key(F.col("name"))
    d = names.withColumn("matched_key", key).withColumn("implementation", _impl(F.col("matched_key"), F.col("task")))
    reason = (
        F.when(F.col("matched_key").isNull(), F.concat(F.lit("unknown model: "), F.col("name")))
        .when(F.col("implementation").isNull(), F.concat(F.col("name"), F.lit(": not for "), F.col("task")))
    )
    return d.withColumn("skip_reason", reason)


def model_names(valid_plans: DataFrame) -> DataFrame:
    """(plan_id, run_id, position, name) of every recommended model."""
    return valid_plans.select("plan_id", "run_id", F.posexplode("recommended_models").alias("position", "name"))


def exclude_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """TRN-4: candidates (run_id, position, model) minus the run's rejected
    models (run_id, model), case-insensitively; a run left with none falls
    back to the known models minus the rejected ones.

    (run_id, position, model, source)"""
    rej = rejected.select("run_id", F.lower("model").alias("__lm")).distinct()
    cand = candidates.withColumn("__lm", F.lower("model"))
    kept = cand.join(rej, ["run_id", "__lm"], "left_anti").select("run_id", "position", "model", F.lit("plan").alias("source"))
    runs = candidates.select("run_id").distinct()
    empty_runs = runs.join(kept.select("run_id").distinct(), "run_id", "left_anti")
    known = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("model")) for i, m in enumerate(KNOWN_MODELS)])
    fb = empty_runs.select("run_id", F.inline(known)).withColumn("__lm", F.lower("model"))
    fb = fb.join(rej, ["run_id", "__lm"], "left_anti").select("run_id", F.col("position").cast("int").alias("position"), "model", F.lit("fallback").alias("source"))
    return kept.unionByName(fb)
