"""Evaluation queries (TRN-2, TRN-10..12, GOV-6) over fixed score rules on
the hash-split test side of ``gov`` - SQL-checkable without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import evaluate as E
from gavel.operators import plan_text as PT
from gavel.operators import train as TR
from gavel.plans.q_plan import W as plan_with
from gavel.plans.registry import query
from gavel.plans.sql import GOV, with_
from gavel.sources import fixtures as fx

SPLIT_SQL = "md5('42|' || CAST(order_id AS VARCHAR)) < '33333333'"


def _test_side(spark, sf) -> DataFrame:
    return TR.hash_split(fx.gov(spark, sf), "order_id")[1]


def score_rules(df: DataFrame) -> DataFrame:
    """(model, label, pred, score) for three fixed classifiers."""
    label = (F.col("income") == ">50K").cast("long")
    cut = F.lit(300000) + F.when(F.col("gender") == "F", F.lit(40000)).otherwise(F.lit(0))
    coarse = F.round(F.col("total") / 500000, 1)
    rules = F.array(
        F.struct(F.lit("total_rule").alias("model"), (F.col("total") > cut).cast("long").alias("pred"), (F.col("total") / 500000).alias("score")),
        F.struct(F.lit("fee_rule").alias("model"), (F.col("fee") > 25000).cast("long").alias("pred"), (F.col("fee") / 40000).alias("score")),
        F.struct(F.lit("coarse_rule").alias("model"), (coarse >= 0.7).cast("long").alias("pred"), coarse.alias("score")),
    )
    return df.select(label.alias("label"), F.inline(rules))


_RULES_SQL = f"""t AS (SELECT * FROM gov WHERE {SPLIT_SQL}),
p AS (
  SELECT 'total_rule' AS model, CAST(income = '>50K' AS BIGINT) AS label,
         CAST(total > 300000 + CASE WHEN gender = 'F' THEN 40000 ELSE 0 END AS BIGINT) AS pred, total / 500000 AS score FROM t
  UNION ALL SELECT 'fee_rule', CAST(income = '>50K' AS BIGINT), CAST(fee > 25000 AS BIGINT), fee / 40000 FROM t
  UNION ALL SELECT 'coarse_rule', CAST(income = '>50K' AS BIGINT), CAST(round(total / 500000, 1) >= 0.7 AS BIGINT), round(total / 500000, 1) FROM t)"""

_CM_SQL = """cm AS (SELECT model, label, pred, count(*) AS n FROM p GROUP BY ALL),
cls AS (
  SELECT model, c, coalesce(sum(CASE WHEN label = c THEN n END), 0) AS support,
         coalesce(sum(CASE WHEN pred = c THEN n END), 0) AS predicted,
         coalesce(sum(CASE WHEN label = c AND pred = c THEN n END), 0) AS tp
  FROM cm, (SELECT DISTINCT label AS c FROM cm UNION SELECT DISTINCT pred FROM cm) cs GROUP BY model, c),
f1c AS (
  SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS pr,
            CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS rc FROM cls),
f1m AS (
  SELECT model, count_if(support > 0) AS k, sum(support) AS n, sum(tp) AS correct,
         max(CASE WHEN c = 1 THEN CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END END) AS f1_pos,
         sum((CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) * support) / sum(support) AS f1_w
  FROM f1c GROUP BY model),
f1 AS (SELECT model, round(CAST(correct AS DOUBLE) / n, 4) AS accuracy,
              round(CASE WHEN k = 2 THEN coalesce(f1_pos, 0) ELSE f1_w END, 4) AS f1 FROM f1m)"""

_AUC_SQL = """bs AS (SELECT model, score, sum(label) AS p, count(*) AS n FROM p GROUP BY model, score),
br AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bs),
au AS (
  SELECT br.model,
         CASE WHEN lk.k = 2 AND lk.lo = 0 AND lk.hi = 1 THEN
           round((sum(p * (before + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))), 4) END AS auc_roc
  FROM br JOIN (SELECT model, count(DISTINCT label) AS k, min(label) AS lo, max(label) AS hi FROM p GROUP BY model) lk ON br.model = lk.model
  GROUP BY br.model, lk.k, lk.lo, lk.hi)"""


# ---------------------------------------------------------------- TRN-2
@query(
    "split_hash",
    with_("gov") + f"SELECT {SPLIT_SQL} AS is_test, count(*) AS n, count_if(income = '>50K') AS positives FROM gov GROUP BY 1",
)
def split_hash(spark, sf):
    df = TR.with_split(fx.gov(spark, sf), "order_id")
    return df.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("income") == ">50K").alias("positives"))


@query(
    "split_stratified",
    with_("gov")
    + """, h AS (SELECT income, md5('42|' || CAST(order_id AS VARCHAR)) AS hk FROM gov),
r AS (SELECT income, hk, row_number() OVER (PARTITION BY income ORDER BY hk) AS rn, count(*) OVER (PARTITION BY income) AS cnt FROM h)
SELECT income, rn <= CAST(ceil(cnt * 0.2) AS BIGINT) AS is_test, count(*) AS n FROM r GROUP BY ALL""",
)
def split_stratified(spark, sf):
    df = TR.stratified_split(fx.gov(spark, sf), "order_id", "income", 0.2)
    return df.groupBy("income", "is_test").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- TRN-10
@query("metrics_classification", with_("gov", _RULES_SQL, _CM_SQL, _AUC_SQL) + "SELECT f1.model, accuracy, f1, auc_roc FROM f1 LEFT JOIN au ON f1.model = au.model")
def metrics_classification(spark, sf):
    return E.classification_metrics(score_rules(_test_side(spark, sf)))


@query("metrics_auc", with_("gov", _RULES_SQL, _AUC_SQL) + "SELECT model, auc_roc FROM au")
def metrics_auc(spark, sf):
    return E.auc(score_rules(_test_side(spark, sf)))


_MC_SQL = f"""t AS (SELECT * FROM gov WHERE {SPLIT_SQL}),
p AS (SELECT 'year_from_balance' AS model, CAST(order_year - 1995 AS BIGINT) AS label,
             CAST(least(floor((balance + 1000) / 1572), 6) AS BIGINT) AS pred, 0.0 AS score FROM t)"""


@query("metrics_f1_weighted", with_("gov", _MC_SQL, _CM_SQL) + "SELECT model, accuracy, f1 FROM f1")
def metrics_f1_weighted(spark, sf):
    t = _test_side(spark, sf)
    p = t.select(
        F.lit("year_from_balance").alias("model"),
        (F.col("order_year") - 1995).cast("long").alias("label"),
        F.least(F.floor((F.col("balance") + 1000) / 1572), F.lit(6)).cast("long").alias("pred"),
    )
    return E.f1_scores(E.confusion(p)).select("model", "accuracy", "f1")


# ---------------------------------------------------------------- TRN-11
_REG_SQL = f"""t AS (SELECT * FROM gov WHERE {SPLIT_SQL}),
p AS (SELECT 'fee_based' AS model, total AS y, (fee - balance) / 0.07 AS yhat FROM t
      UNION ALL SELECT 'balance_based', total, 50 * balance + 100000 FROM t
      UNION ALL SELECT 'constant', total, 250000.0 FROM t)"""


@query(
    "metrics_regression",
    with_("gov", _REG_SQL)
    + """SELECT model, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae,
       round(CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))
                  WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2
FROM p GROUP BY model""",
)
def metrics_regression(spark, sf):
    t = _test_side(spark, sf)
    rules = F.array(
        F.struct(F.lit("fee_based").alias("model"), ((F.col("fee") - F.col("balance")) / 0.07).alias("yhat")),
        F.struct(F.lit("balance_based").alias("model"), (F.col("balance") * 50 + 100000).alias("yhat")),
        F.struct(F.lit("constant").alias("model"), F.lit(250000.0).alias("yhat")),
    )
    p = t.select(F.col("total").alias("y"), F.inline(rules))
    return E.regression_metrics(p)


# ---------------------------------------------------------------- TRN-12, GOV-6
# Which score rule stands in for each implementation.
IMPL_RULE = {"logistic": "total_rule", "random_forest": "fee_rule", "gbt_deep": "coarse_rule", "gbt_shallow": "total_rule"}


def _entries(spark, sf) -> DataFrame:
    vp = PT.validate(fx.plan_texts(spark, sf)).where("valid")
    names = PT.model_names(vp).withColumn("task", F.lit("classification"))
    res = PT.resolve(names)
    mets = E.classification_metrics(score_rules(_test_side(spark, sf)))
    impl = spark.createDataFrame(list(IMPL_RULE.items()), "implementation string, model string")
    m = F.broadcast(mets.join(impl, "model").drop("model"))  # one row per implementation
    e = res.join(m, "implementation", "left")
    return e.select(
        F.col("plan_id").alias("run_id"), F.col("position").alias("input_pos"), F.col("name").alias("model_name"),
        F.col("skip_reason").isNull().alias("trained_successfully"), "accuracy", "f1", "auc_roc",
    )


_IMPL_SQL = "impl(implementation, model) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in IMPL_RULE.items()) + ")"


def _lb_sql() -> str:
    from gavel.plans.q_plan import _impl_sql, _key_sql

    return f"""{GOV}, {_RULES_SQL}, {_CM_SQL}, {_AUC_SQL}, {_IMPL_SQL},
mets AS (SELECT impl.implementation, f1.accuracy, f1.f1, au.auc_roc FROM f1 JOIN au ON f1.model = au.model JOIN impl ON impl.model = f1.model),
nm AS (SELECT plan_id AS run_id, CAST(generate_subscripts(recommended_models, 1) - 1 AS INTEGER) AS input_pos, unnest(recommended_models) AS model_name FROM vp),
nk AS (SELECT *, {_key_sql("regexp_replace(lower(model_name), '[-_ ]', '', 'g')")} AS mk FROM nm),
ni AS (SELECT *, {_impl_sql("mk", "'classification'")} AS implementation FROM nk),
en AS (SELECT ni.run_id, ni.input_pos, ni.model_name, ni.implementation IS NOT NULL AS trained_successfully,
              mets.accuracy, mets.f1, mets.auc_roc FROM ni LEFT JOIN mets ON ni.implementation = mets.implementation),
lb AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY trained_successfully DESC,
                   CASE WHEN trained_successfully THEN -coalesce(auc_roc, f1, 0.0) END ASC NULLS LAST, input_pos ASC) AS BIGINT) AS rank FROM en),
lbs AS (SELECT *, rank = 1 AND trained_successfully AS selected FROM lb)"""


@query("leaderboard", plan_with(_lb_sql()) + "SELECT run_id, input_pos, model_name, trained_successfully, accuracy, f1, auc_roc, rank, selected FROM lbs")
def leaderboard(spark, sf):
    return E.leaderboard(_entries(spark, sf), "classification")


@query(
    "leaderboard_view",
    plan_with(_lb_sql())
    + """SELECT run_id, rank, model_name, CASE WHEN selected THEN 'selected' ELSE '' END AS selection,
       CASE WHEN accuracy IS NULL THEN '-' ELSE printf('%.4f', accuracy) END AS accuracy,
       CASE WHEN f1 IS NULL THEN '-' ELSE printf('%.4f', f1) END AS f1,
       CASE WHEN auc_roc IS NULL THEN '-' ELSE printf('%.4f', auc_roc) END AS auc_roc,
       CASE WHEN trained_successfully THEN 'trained' ELSE 'failed' END AS status
FROM lbs""",
)
def leaderboard_view(spark, sf):
    return E.leaderboard_view(E.leaderboard(_entries(spark, sf), "classification"))
