"""Fairness queries (FAI-1..6, GOV-7) over fixed, data-derived predictions
of the ``gov`` table, so that SQL can check them without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.operators import fairness as FA
from gavel.plans.registry import query
from gavel.plans.sql import with_
from gavel.sources import fixtures as fx

# The candidate list of the audits (with a duplicate after
# trimming, a float, a high-cardinality and an unknown name).
CANDIDATES = ["gender", "region", "segment", "nation", "balance", "order_year", "express", "unknown_attr", " gender", "priority"]
ONEHOT_CANDIDATES = ["gender", "region", "segment", "priority", "nation", "total"]
OFFSETS = {"fair": 40000, "unfair": 90000}


def with_pred(df: DataFrame, offset: int) -> DataFrame:
    """Fixed classifier: positive when total is above 300000 plus an
    offset for group F."""
    cut = F.lit(300000) + F.when(F.col("gender") == "F", F.lit(offset)).otherwise(F.lit(0))
    return df.withColumn("pred", (F.col("total") > cut).cast("int"))


def _pred_sql(offset: int) -> str:
    return f"CAST(total > 300000 + CASE WHEN gender = 'F' THEN {offset} ELSE 0 END AS INTEGER)"


_DIRECT = ["gender", "region", "segment", "order_year", "express", "priority"]


def _text(c: str) -> str:
    return "CASE WHEN express THEN 'True' ELSE 'False' END" if c == "express" else f"CAST({c} AS VARCHAR)"


def _groups_sql(table: str, attrs: list[str], pred: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{a}' AS attribute, {_text(a)} AS grp, {pred} AS pred FROM {table}" for a in attrs)


def _rates_sql(offset: int) -> str:
    return f"""g AS ({_groups_sql('gov', _DIRECT, _pred_sql(offset))}),
rates AS (SELECT attribute, grp, round(avg(CAST(pred AS DOUBLE)), 4) AS positive_rate, count(*) AS n FROM g GROUP BY attribute, grp)"""


_DISP = """disp AS (
  SELECT attribute,
         CASE WHEN max(positive_rate) > 0 THEN round(min(positive_rate) / max(positive_rate), 4) ELSE 1.0 END AS disparate_impact,
         round(max(positive_rate) - min(positive_rate), 4) AS demographic_parity_difference,
         arg_min(grp, (-positive_rate, grp)) AS group_a, max(positive_rate) AS group_a_positive_rate,
         arg_max(grp, (-positive_rate, grp)) AS group_b, min(positive_rate) AS group_b_positive_rate
  FROM rates GROUP BY attribute HAVING count(*) >= 2),
rep AS (SELECT *, disparate_impact < 0.8 OR demographic_parity_difference > 0.1 AS violation FROM disp)"""


def _audit(spark, sf, offset: int):
    df = with_pred(fx.gov(spark, sf), offset)
    return FA.audit(df, CANDIDATES, "income", "classification")


# ---------------------------------------------------------------- FAI-1
@query(
    "fair_groups_direct",
    with_("gov") + f", g AS ({_groups_sql('gov', _DIRECT, '1')})\nSELECT attribute, grp, count(*) AS n FROM g GROUP BY attribute, grp",
)
def fair_groups_direct(spark, sf):
    df = fx.gov(spark, sf)
    plan = FA.plan_attributes(df, CANDIDATES, "income")
    return FA.groups_long(df, plan, []).groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- FAI-2
_OH = ["gender", "region", "segment", "priority"]


@query(
    "fair_groups_onehot",
    with_("gov") + f", g AS ({_groups_sql('gov', _OH, '1')})\nSELECT attribute, grp, count(*) AS n FROM g GROUP BY attribute, grp",
)
def fair_groups_onehot(spark, sf):
    cleaned = C.run(fx.gov(spark, sf), "income", "classification", keys=("order_id",)).cleaned
    plan = FA.plan_attributes(cleaned, ONEHOT_CANDIDATES, "income")
    return FA.groups_long(cleaned, plan, []).groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- FAI-3
@query("fair_group_rates", with_("gov", _rates_sql(OFFSETS["fair"])) + "SELECT attribute, grp, positive_rate, n FROM rates")
def fair_group_rates(spark, sf):
    df = with_pred(fx.gov(spark, sf), OFFSETS["fair"])
    return FA.group_rates(df, FA.plan_attributes(df, CANDIDATES, "income"))


# ---------------------------------------------------------------- FAI-4
@query("fair_disparity", with_("gov", _rates_sql(OFFSETS["fair"]), _DISP) + "SELECT * FROM rep")
def fair_disparity(spark, sf):
    return _audit(spark, sf, OFFSETS["fair"])[0]


# ---------------------------------------------------------------- FAI-5
def _scenarios_sql(select: str) -> str:
    parts = []
    for name, off in OFFSETS.items():
        parts.append(
            f"SELECT * FROM (WITH {_rates_sql(off)}, {_DISP} SELECT '{name}' AS scenario, * FROM rep)"
        )
    return with_("gov") + ", allrep AS (" + "\nUNION ALL\n".join(parts) + ")\n" + select


def _scenarios(spark, sf, which: int) -> DataFrame:
    out = None
    for name, off in OFFSETS.items():
        part = _audit(spark, sf, off)[which].select(F.lit(name).alias("scenario"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "fair_violations",
    _scenarios_sql("SELECT scenario, attribute, disparate_impact, demographic_parity_difference, violation FROM allrep"),
)
def fair_violations(spark, sf):
    return _scenarios(spark, sf, 0).select("scenario", "attribute", "disparate_impact", "demographic_parity_difference", "violation")


@query(
    "fair_overall",
    _scenarios_sql(
        """SELECT scenario, coalesce(NOT bool_or(violation), true) AS overall_fairness_passed,
       count(*) AS n_evaluated, count_if(violation) AS n_violations FROM allrep GROUP BY scenario"""
    ),
)
def fair_overall(spark, sf):
    return _scenarios(spark, sf, 1)


# ---------------------------------------------------------------- FAI-6
@query(
    "fair_skipped",
    with_("gov")
    + """SELECT 'nation' AS attribute, CASE WHEN count(DISTINCT nation) > 20 THEN 'nation: more than 20 groups' END AS skipped_entry FROM gov
UNION ALL SELECT 'balance', 'balance: continuous: needs bins before groups can be compared'
UNION ALL SELECT 'unknown_attr', 'unknown_attr: no such column'""",
)
def fair_skipped(spark, sf):
    return _audit(spark, sf, OFFSETS["fair"])[2]


# ---------------------------------------------------------------- GOV-7
@query(
    "fairness_view",
    with_("gov", _rates_sql(OFFSETS["unfair"]), _DISP)
    + """SELECT attribute, CASE WHEN violation THEN 'violated' ELSE 'passed' END AS status,
       printf('%.4f', disparate_impact) AS disparate_impact, printf('%.4f', demographic_parity_difference) AS demographic_parity_difference,
       'highest ' || group_a || ' (' || CAST(group_a_positive_rate AS VARCHAR) || '), lowest ' || group_b || ' (' || CAST(group_b_positive_rate AS VARCHAR) || ')' AS sub_group_positive_rates
FROM rep""",
)
def fairness_view(spark, sf):
    return FA.fairness_view(_audit(spark, sf, OFFSETS["unfair"])[0])
