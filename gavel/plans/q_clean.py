"""Cleaning / encoding / quality-report queries (PRJ-3/4, CLN-1..9,
AGG-14/15) over the ``gov`` fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.plans.registry import query
from gavel.plans.sql import GOV, GOV_CLEAN, GOV_COLUMNS, GOV_FAILING, GOV_FIXABLE, with_
from gavel.sources import fixtures as fx

KEYS = ("order_id",)
TARGET = "income"

# TPC-H fixed domains of the one-hot columns (values, sorted)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
GENDERS = ["F", "M"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DOMAINS = {"segment": SEGMENTS, "gender": GENDERS, "region": REGIONS, "priority": PRIORITIES}


def _round_doubles(df: DataFrame, dp: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), dp).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _dummies_sql(c: str, expr: str | None = None) -> list[str]:
    e = expr or c
    return [f"coalesce({e} = '{v}', false) AS \"{c}_{v}\"" for v in DOMAINS[c]]


# ---------------------------------------------------------------- PRJ-3
def _null_share_sql(table: str, target: str) -> str:
    parts = []
    for i, (c, *_r) in enumerate(GOV_COLUMNS):
        if c == target or c in KEYS:
            continue
        parts.append(
            f"SELECT '{c}' AS column_name, CAST({i} AS BIGINT) AS col_pos, "
            f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_share FROM {table}"
        )
    return "ns AS (" + "\nUNION ALL\n".join(parts) + ")"


@query(
    "clean_drop_columns",
    with_("gov_failing", _null_share_sql("gov_failing", TARGET))
    + """SELECT column_name, col_pos, round(null_share, 6) AS null_share,
       printf('%.1f%% null, above 50%%', null_share * 100) AS reason
FROM ns WHERE null_share > 0.5""",
)
def clean_drop_columns(spark, sf):
    d = C.drop_columns(fx.gov_failing(spark, sf), TARGET, keys=KEYS)
    return d.withColumn("null_share", F.round("null_share", 6))


# ---------------------------------------------------------------- PRJ-4
@query(
    "clean_drop_null_target",
    with_("gov_failing")
    + """SELECT count(*) AS rows_before, count(*) - count(income) AS rows_dropped, count(income) AS rows_kept,
       coalesce(round(CAST(count(*) - count(income) AS DOUBLE) * 100.0 / nullif(count(*), 0), 2), 0.0) AS rows_dropped_pct
FROM gov_failing""",
)
def clean_drop_null_target(spark, sf):
    return C.drop_null_target(fx.gov_failing(spark, sf), TARGET)[1]


# ---------------------------------------------------------------- CLN-1/2
@query(
    "impute_median",
    with_("gov_clean")
    + """, base AS (SELECT * FROM gov_clean WHERE income IS NOT NULL)
SELECT 'balance' AS column_name, round(quantile_cont(balance, 0.5), 6) AS median, count(*) - count(balance) AS nulls_filled FROM base""",
)
def impute_median(spark, sf):
    t = C.median_table(fx.gov_clean(spark, sf), TARGET, KEYS)
    return t.withColumn("median", F.round("median", 6))


def _mode_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS column_name,
       (SELECT {c} FROM base WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS mode,
       (SELECT count(*) - count({c}) FROM base) AS nulls_filled"""
        )
    return f", base AS (SELECT * FROM {table} WHERE income IS NOT NULL)\n" + "\nUNION ALL\n".join(parts)


@query("impute_mode", with_("gov_fixable") + _mode_sql("gov_fixable", ["priority"]))
def impute_mode(spark, sf):
    return C.mode_table(fx.gov_fixable(spark, sf), TARGET, KEYS)


# ---------------------------------------------------------------- CLN-3
_label_sql = """SELECT income AS value, CAST(row_number() OVER (ORDER BY income) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT income FROM gov WHERE income IS NOT NULL)"""


@query("label_encode", with_("gov") + _label_sql)
def label_encode(spark, sf):
    return C.label_mapping(fx.gov(spark, sf), TARGET)


# ---------------------------------------------------------------- CLN-4
_ohe_cols = ["segment", "gender", "region", "priority"]


@query(
    "one_hot",
    with_("gov") + "SELECT order_id, " + ", ".join(d for c in _ohe_cols for d in _dummies_sql(c)) + " FROM gov",
)
def one_hot(spark, sf):
    df = fx.gov(spark, sf).select("order_id", *_ohe_cols)
    return C.one_hot_encode(df, _ohe_cols)


# ---------------------------------------------------------------- CLN-5
@query(
    "frequency_encode",
    with_("gov")
    + """, fq AS (SELECT nation AS v, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM gov) AS f FROM gov GROUP BY nation)
SELECT g.order_id, round(fq.f, 6) AS nation FROM gov g LEFT JOIN fq ON g.nation = fq.v""",
)
def frequency_encode(spark, sf):
    df = fx.gov(spark, sf).select("order_id", "nation")
    return _round_doubles(C.frequency_encode(df, ["nation"]))


# ---------------------------------------------------------------- CLN-6
_sc = ["balance", "total", "fee", "order_year"]


def _scaled_sql(c: str, src: str = None) -> str:
    e = src or f"CAST({c} AS DOUBLE)"
    return f"round(({e} - st.m_{c}) / coalesce(nullif(st.s_{c}, 0), 1), 6) AS {c}"


_st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _sc)


@query(
    "standard_scale",
    with_("gov") + f", st AS (SELECT {_st} FROM gov)\nSELECT g.order_id, " + ", ".join(_scaled_sql(c) for c in _sc) + " FROM gov g, st",
)
def standard_scale(spark, sf):
    return _round_doubles(C.standard_scale(fx.gov(spark, sf).select("order_id", *_sc), _sc))


# ---------------------------------------------------------------- CLN-7
_run_scaled = ["nation", "balance", "total", "fee", "order_year"]
_st_run = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _run_scaled)
_clean_run_cte = f"""base AS (SELECT * FROM gov_clean WHERE income IS NOT NULL),
med AS (SELECT quantile_cont(balance, 0.5) AS m FROM base),
mp AS (SELECT priority AS v FROM base WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority ASC LIMIT 1),
imp AS (SELECT order_id, segment, gender, region, nation,
               coalesce(priority, (SELECT v FROM mp)) AS priority,
               coalesce(balance, (SELECT m FROM med)) AS balance,
               CAST(total AS DOUBLE) AS total, CAST(fee AS DOUBLE) AS fee, CAST(order_year AS DOUBLE) AS order_year,
               express, income FROM base),
fq AS (SELECT nation AS v, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM imp) AS f FROM imp GROUP BY nation),
enc AS (SELECT imp.* REPLACE (fq.f AS nation) FROM imp LEFT JOIN fq ON imp.nation = fq.v),
st AS (SELECT {_st_run} FROM enc),
lab AS (SELECT income AS v, row_number() OVER (ORDER BY income) - 1 AS code FROM (SELECT DISTINCT income FROM base))"""


@query(
    "clean_run",
    with_("gov_clean", _clean_run_cte)
    + "SELECT e.order_id, "
    + ", ".join(_scaled_sql(c, f"e.{c}") for c in _run_scaled)
    + ", e.express, CAST((SELECT code FROM lab WHERE lab.v = e.income) AS BIGINT) AS income, "
    + ", ".join(d for c in _ohe_cols for d in _dummies_sql(c, f"e.{c}"))
    + " FROM enc e, st",
)
def clean_run(spark, sf):
    r = C.run(fx.gov_clean(spark, sf), TARGET, "classification", keys=KEYS)
    return _round_doubles(r.cleaned)


# ---------------------------------------------------------------- CLN-8
_act_failing = """, ns AS (SELECT 'segment' AS c, 1 AS pos, CAST(count(*) - count(segment) AS DOUBLE) / count(*) AS s FROM gov_failing
  UNION ALL SELECT 'nation', 4, CAST(count(*) - count(nation) AS DOUBLE) / count(*) FROM gov_failing
  UNION ALL SELECT 'priority', 5, CAST(count(*) - count(priority) AS DOUBLE) / count(*) FROM gov_failing),
rd AS (SELECT count(*) - count(income) AS k, count(*) AS n FROM gov_failing),
cc AS (SELECT income, count(*) AS n FROM gov_failing WHERE income IS NOT NULL GROUP BY income),
acts AS (
  SELECT row_number() OVER (ORDER BY pos) - 1 AS seq, 'drop_column' AS step, c AS column_name,
         printf('%.1f%% null, above 50%%', s * 100) AS detail
  FROM ns WHERE s > 0.5
  UNION ALL
  SELECT 3, 'drop_rows', 'income', printf('rows=%d share=%.3f', k, CAST(k AS DOUBLE) / n) FROM rd
  UNION ALL
  SELECT 4, 'label_encode', 'income', 'classes=' || count(*) FROM cc
  UNION ALL
  SELECT 5, 'one_hot', 'gender', 'columns=' || count(DISTINCT gender) FROM gov_failing WHERE income IS NOT NULL
  UNION ALL
  SELECT 6, 'one_hot', 'region', 'columns=' || count(DISTINCT region) FROM gov_failing WHERE income IS NOT NULL
  UNION ALL
  SELECT 7, 'scale', NULL, 'columns=balance,total,fee,order_year'
  UNION ALL
  SELECT 8, 'imbalance_note', 'income',
         printf('largest class %.2f times the smallest; resampling and weights are left to training', CAST(max(n) AS DOUBLE) / min(n))
  FROM cc HAVING count(*) >= 2 AND (CAST(max(n) AS DOUBLE) / min(n) > 1.5))
SELECT CAST(seq AS BIGINT) AS seq, step, column_name, detail FROM acts"""


@query("cleaning_actions", with_("gov_failing") + _act_failing)
def cleaning_actions(spark, sf):
    return C.run(fx.gov_failing(spark, sf), TARGET, "classification", keys=KEYS).actions


# ---------------------------------------------------------------- CLN-9
@query(
    "imbalance_note",
    with_("gov_clean")
    + """, cc AS (SELECT income, count(*) AS n FROM gov_clean WHERE income IS NOT NULL GROUP BY income)
SELECT round(CAST(max(n) AS DOUBLE) / min(n), 4) AS ratio,
       printf('largest class %.2f times the smallest; resampling and weights are left to training', CAST(max(n) AS DOUBLE) / min(n)) AS note
FROM cc HAVING count(*) >= 2 AND CAST(max(n) AS DOUBLE) / min(n) > 1.5""",
)
def imbalance_note(spark, sf):
    f = C.fit(fx.gov_clean(spark, sf), TARGET, "classification", keys=KEYS)
    note = C.imbalance_note_text(f)
    rows = [(round(f.imbalance_ratio, 4), note)] if note else []
    return spark.createDataFrame(rows, "ratio double, note string")


# ---------------------------------------------------------------- AGG-14/15
def report_row(variant: str, r: C.CleanResult) -> DataFrame:
    rep = r.report
    return rep.select(
        F.lit(variant).alias("variant"),
        "missing_pct_after_cleaning",
        "class_balance_ratio",
        "rows_dropped",
        "rows_dropped_pct",
        F.array_join("columns_dropped", ", ").alias("columns_dropped"),
        F.array_join("unresolved_null_columns", ", ").alias("unresolved_null_columns"),
        F.array_join("unhandled_high_null_columns", ", ").alias("unhandled_high_null_columns"),
        "quality_check_passed",
    )


def _reports(spark, sf) -> DataFrame:
    out = None
    for v in ("gov_clean", "gov_failing", "gov_fixable"):
        r = report_row(v, C.run(fx.gov_variant(spark, sf, v), TARGET, "classification", keys=KEYS))
        out = r if out is None else out.unionByName(r)
    return out


# cleaned-table column counts per variant (one-hot expands 4 / 2 columns)
_NCOLS = {"gov_clean": 25, "gov_failing": 14, "gov_fixable": 25}


def _report_sql(variant: str, dropped: list[str]) -> str:
    feats = [c for c, *_r in GOV_COLUMNS if c not in dropped]
    # a kept column keeps nulls only when it has no value at all after the row drop
    nulls_after = " + ".join(f"(CASE WHEN count({c}) = 0 THEN count(*) ELSE 0 END)" for c in feats)
    unhandled = " || ".join(
        f"CASE WHEN CAST(count(*) - count({c}) AS DOUBLE) / count(*) >= 0.35 THEN '{c} (' || printf('%.1f', CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*)) || '% null), ' ELSE '' END"
        for c, *_r in GOV_COLUMNS
        if c not in dropped and c not in ("order_id", "income")
    )
    return f"""SELECT '{variant}' AS variant,
       (SELECT coalesce(round(CAST({nulls_after} AS DOUBLE) * 100 / nullif(count(*) * {_NCOLS[variant]}, 0), 4), 0.0)
          FROM {variant} WHERE income IS NOT NULL) AS missing_pct_after_cleaning,
       (SELECT CASE WHEN count(*) >= 2 THEN round(CAST(max(n) AS DOUBLE) / min(n), 4) END
          FROM (SELECT income, count(*) AS n FROM {variant} WHERE income IS NOT NULL GROUP BY income)) AS class_balance_ratio,
       count(*) - count(income) AS rows_dropped,
       round(CAST(count(*) - count(income) AS DOUBLE) * 100 / count(*), 2) AS rows_dropped_pct,
       '{", ".join(dropped)}' AS columns_dropped,
       '' AS unresolved_null_columns,
       rtrim({unhandled or "''"}, ', ') AS unhandled_high_null_columns
FROM {variant}"""


_reports_sql = (
    "WITH "
    + ",\n".join([GOV, GOV_CLEAN, GOV_FAILING, GOV_FIXABLE])
    + ",\nrep AS ("
    + _report_sql("gov_clean", [])
    + "\nUNION ALL\n"
    + _report_sql("gov_failing", ["segment", "nation", "priority"])
    + "\nUNION ALL\n"
    + _report_sql("gov_fixable", [])
    + ")\n"
)
_gate = "(missing_pct_after_cleaning < 5 AND unresolved_null_columns = '' AND rows_dropped_pct < 30 AND unhandled_high_null_columns = '')"


@query("quality_report", _reports_sql + f"SELECT *, {_gate} AS quality_check_passed FROM rep")
def quality_report(spark, sf):
    return _reports(spark, sf)


@query("quality_gate", _reports_sql + f"SELECT variant, {_gate} AS quality_check_passed FROM rep")
def quality_gate(spark, sf):
    return _reports(spark, sf).select("variant", "quality_check_passed")
