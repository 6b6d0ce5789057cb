"""Profiling queries (AGG-1..13, PRJ-5) over the ``gov`` fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import profile as P
from gavel.plans.registry import query
from gavel.plans.sql import CATEGORICAL, GOV_COLUMNS, NUMERIC, long_values, text, with_
from gavel.sources import fixtures as fx

T = "gov_clean"


def _d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


# ---------------------------------------------------------------- AGG-2
_cols_sql = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, CAST({i} AS BIGINT) AS col_pos, '{dt}' AS dtype,
       count(*) - count({c}) AS null_count,
       coalesce(round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / nullif(count(*), 0), 2), 0.0) AS null_pct,
       count(DISTINCT {c}) AS cardinality, {str(num).lower()} AS is_numeric
FROM {T}"""
    for i, (c, dt, num, _) in enumerate(GOV_COLUMNS)
)


@query("profile_columns", with_(T) + _cols_sql)
def profile_columns(spark, sf):
    return P.profile_columns(fx.gov_clean(spark, sf))


# ---------------------------------------------------------------- AGG-3
_pos = {c: i for i, (c, *_rest) in enumerate(GOV_COLUMNS)}
_num_sql = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, CAST({_pos[c]} AS BIGINT) AS col_pos,
       round(min({_d(c)}), 4) AS min, round(max({_d(c)}), 4) AS max,
       round(avg({_d(c)}), 4) AS mean, round(stddev_samp({_d(c)}), 4) AS std
FROM {T}"""
    for c in NUMERIC
)


@query("profile_numeric", with_(T) + _num_sql)
def profile_numeric(spark, sf):
    return P.profile_numeric(fx.gov_clean(spark, sf))


# ---------------------------------------------------------------- AGG-4
_iqr_cte = f"""vals AS ({long_values(T, NUMERIC, True)}),
q AS (SELECT column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM vals WHERE value IS NOT NULL GROUP BY column_name),
b AS (SELECT column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
o AS (SELECT b.column_name, b.q1, b.q3, b.lower, b.upper,
             CAST(sum(CASE WHEN v.value < b.lower OR v.value > b.upper THEN 1 ELSE 0 END) AS BIGINT) AS outliers
      FROM vals v JOIN b ON v.column_name = b.column_name
      WHERE v.value IS NOT NULL
      GROUP BY b.column_name, b.q1, b.q3, b.lower, b.upper)"""


def _iqr_out(df):
    return df.select("column_name", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")], "outliers")


# a heavy-tailed column: the cube of a balance has values beyond the fences
_CUBED = "cubed AS (SELECT order_id, balance * balance * balance AS cube, total, order_year FROM gov_clean)"
_cubed_iqr = _iqr_cte.replace(long_values(T, NUMERIC, True), long_values("cubed", ["order_id", "cube", "total", "order_year"], True))


@query(
    "outliers_iqr",
    with_(T, _CUBED, _cubed_iqr)
    + "SELECT column_name, round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper, outliers FROM o WHERE outliers > 0",
)
def outliers_iqr(spark, sf):
    b = F.col("balance")
    return _iqr_out(P.outliers_iqr(fx.gov_clean(spark, sf).select("order_id", (b * b * b).alias("cube"), "total", "order_year")))


@query(
    "iqr_quartiles",
    with_(T, _iqr_cte)
    + "SELECT column_name, round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper, outliers FROM o",
)
def iqr_quartiles(spark, sf):
    """AGG-4 with every numeric column (also those without outliers)."""
    return _iqr_out(P.outlier_counts(fx.gov_clean(spark, sf)))


# ---------------------------------------------------------------- AGG-5
_top_sql = f"""vals AS ({long_values(T, CATEGORICAL, False)}),
vc AS (SELECT column_name, value, count(*) AS n FROM vals WHERE value IS NOT NULL GROUP BY column_name, value),
r AS (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rank FROM vc)"""


@query("top_categories", with_(T, _top_sql) + "SELECT column_name, CAST(rank AS BIGINT) AS rank, value, n FROM r WHERE rank <= 5")
def top_categories(spark, sf):
    return P.top_categories(fx.gov_clean(spark, sf), 5)


# ---------------------------------------------------------------- AGG-6
def _pairs_sql(table: str) -> str:
    parts, p = [], 0
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i + 1 :]:
            da, db = _d(a), _d(b)
            parts.append(
                f"""SELECT CAST({p} AS BIGINT) AS pair_pos, '{a}' AS feature_a, '{b}' AS feature_b,
       covar_samp({da}, {db}) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {da} END)
                                      * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {db} END), 0) AS r
FROM {table}"""
            )
            p += 1
    return "pairs AS (" + "\nUNION ALL\n".join(parts) + ")"


_corr_cte = (
    _pairs_sql(T)
    + """,
top AS (SELECT feature_a, feature_b, round(r, 4) AS correlation, pair_pos FROM pairs
        WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.2
        ORDER BY abs(round(r, 4)) DESC, pair_pos ASC LIMIT 10),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY abs(correlation) DESC, pair_pos ASC) AS BIGINT) AS rank,
                  feature_a, feature_b, correlation FROM top)"""
)


@query("correlations_top", with_(T, _corr_cte) + "SELECT rank, feature_a, feature_b, correlation FROM ranked")
def correlations_top(spark, sf):
    return P.correlations_top(fx.gov_clean(spark, sf))


@query("chart_correlation", with_(T, _corr_cte) + "SELECT rank, feature_a || ' vs ' || feature_b AS label, correlation FROM ranked")
def chart_correlation(spark, sf):
    return P.chart_correlation(fx.gov_clean(spark, sf))


# ---------------------------------------------------------------- AGG-1, AGG-10
_cells = " + ".join(f"(count(*) - count({c}))" for c, *_ in GOV_COLUMNS)
_ncols = len(GOV_COLUMNS)
_sum_cte = f"""cells AS (SELECT count(*) AS total_rows, CAST({_cells} AS BIGINT) AS missing_cells FROM {T}),
{_iqr_cte}"""


@query(
    "profile_summary",
    with_(T, _sum_cte)
    + f"""SELECT total_rows, CAST({_ncols} AS BIGINT) AS total_columns, missing_cells,
       total_rows * {_ncols} - missing_cells AS clean_cells,
       coalesce(round(CAST(missing_cells AS DOUBLE) * 100.0 / nullif(total_rows * {_ncols}, 0), 2), 0.0) AS missing_pct,
       CAST({len(NUMERIC)} AS BIGINT) AS numeric_columns_count,
       CAST({len(CATEGORICAL)} AS BIGINT) AS categorical_columns_count,
       (SELECT count(*) FROM o WHERE outliers > 0) AS outlier_columns_count
FROM cells""",
)
def profile_summary(spark, sf):
    return P.summary(fx.gov_clean(spark, sf))


@query(
    "chart_missingness",
    with_(T, _sum_cte)
    + f"""SELECT 'clean' AS kind, total_rows * {_ncols} - missing_cells AS cells FROM cells
UNION ALL SELECT 'missing' AS kind, missing_cells AS cells FROM cells""",
)
def chart_missingness(spark, sf):
    return P.chart_missingness(fx.gov_clean(spark, sf))


# ---------------------------------------------------------------- AGG-7
_hist_sql = """st AS (SELECT min(total) AS mn, max(total) AS mx, count(DISTINCT total) AS nd FROM gov WHERE total IS NOT NULL),
e AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS e0, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS e1 FROM st WHERE nd > 15),
g AS (SELECT CAST(i AS BIGINT) AS bin, e0, e1 FROM e, range(10) t(i)),
b0 AS (SELECT v.total AS v, e.e0, e.e1,
              least(CAST(floor((v.total - e.e0) * (10.0 / (e.e1 - e.e0))) AS INTEGER), 9) AS k
       FROM gov v, e WHERE v.total IS NOT NULL),
b1 AS (SELECT CAST(k
         - CASE WHEN v < (CASE WHEN k >= 10 THEN e1 ELSE e0 + CAST(k AS DOUBLE) * ((e1 - e0) / 10) END) THEN 1 ELSE 0 END
         + CASE WHEN v >= (CASE WHEN k + 1 >= 10 THEN e1 ELSE e0 + CAST(k + 1 AS DOUBLE) * ((e1 - e0) / 10) END) AND k <> 9 THEN 1 ELSE 0 END
         AS BIGINT) AS bin FROM b0),
c AS (SELECT bin, count(*) AS n FROM b1 GROUP BY bin),
out AS (SELECT g.bin,
               CASE WHEN g.bin >= 10 THEN g.e1 ELSE g.e0 + CAST(g.bin AS DOUBLE) * ((g.e1 - g.e0) / 10) END AS lo,
               CASE WHEN g.bin + 1 >= 10 THEN g.e1 ELSE g.e0 + CAST(g.bin + 1 AS DOUBLE) * ((g.e1 - g.e0) / 10) END AS hi,
               coalesce(c.n, 0) AS n
        FROM g LEFT JOIN c ON g.bin = c.bin)"""


@query(
    "target_histogram",
    with_("gov", _hist_sql) + "SELECT bin, printf('%.2f - %.2f', lo, hi) AS label, round(lo, 4) AS lo, round(hi, 4) AS hi, n FROM out",
)
def target_histogram(spark, sf):
    return P.target_histogram(fx.gov(spark, sf), "total")


# ---------------------------------------------------------------- AGG-8
@query(
    "target_numeric_stats",
    with_("gov")
    + """SELECT round(min(total), 4) AS min, round(max(total), 4) AS max, round(avg(total), 4) AS mean,
       round(stddev_samp(total), 4) AS std, round(skewness(total), 4) AS skew FROM gov""",
)
def target_numeric_stats(spark, sf):
    return P.target_numeric_stats(fx.gov(spark, sf), "total")


# ---------------------------------------------------------------- AGG-9
@query(
    "target_class_counts",
    with_("gov_failing")
    + """, vc AS (SELECT income AS value, count(*) AS n FROM gov_failing WHERE income IS NOT NULL GROUP BY income)
SELECT CAST(row_number() OVER (ORDER BY n DESC, value ASC) AS BIGINT) AS rank, value, n,
       (SELECT count(*) FROM vc) AS unique_classes
FROM vc ORDER BY n DESC, value ASC LIMIT 10""",
)
def target_class_counts(spark, sf):
    return P.target_class_counts(fx.gov_failing(spark, sf), "income")


# ---------------------------------------------------------------- AGG-11
@query(
    "class_imbalance",
    with_("gov_failing")
    + """, vc AS (SELECT income, count(*) AS n FROM gov_failing WHERE income IS NOT NULL GROUP BY income)
SELECT count(*) AS n_classes,
       CASE WHEN count(*) >= 2 THEN round(CAST(max(n) AS DOUBLE) / min(n), 2) ELSE 1.0 END AS imbalance_ratio,
       CASE WHEN count(*) >= 2 THEN round(CAST(max(n) AS DOUBLE) / min(n), 4) END AS balance_ratio
FROM vc""",
)
def class_imbalance(spark, sf):
    return P.class_imbalance(fx.gov_failing(spark, sf), "income")


# ---------------------------------------------------------------- AGG-12
_skew_cte = """s AS (SELECT round(avg(total), 4) AS mean, round(stddev_samp(total), 4) AS std,
              round(min(total), 4) AS min, round(max(total), 4) AS max FROM gov)"""


@query(
    "regression_skew_flag",
    with_("gov", _skew_cte)
    + "SELECT mean, std, min, max, max - min AS range, coalesce(std > 0 AND (max - min) > 3 * std, false) AS severe_skew FROM s",
)
def regression_skew_flag(spark, sf):
    return P.regression_skew(fx.gov(spark, sf), "total")


# ---------------------------------------------------------------- AGG-13
def _null_flag_sql(table: str) -> str:
    parts = []
    for i, (c, *_r) in enumerate(GOV_COLUMNS):
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS flag_pos, '{c}' AS column_name, "
            f"CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / count(*) AS p FROM {table}"
        )
    return "np AS (" + "\nUNION ALL\n".join(parts) + ")"


@query(
    "quality_flags",
    with_(T, _null_flag_sql(T))
    + f""", vc AS (SELECT income, count(*) AS n FROM {T} WHERE income IS NOT NULL GROUP BY income),
ci AS (SELECT CASE WHEN count(*) >= 2 THEN round(CAST(max(n) AS DOUBLE) / min(n), 2) ELSE 1.0 END AS ratio FROM vc)
SELECT flag_pos, 'null_rate' AS kind, column_name, printf('%s: %.1f%% of the values are null', column_name, p) AS flag
FROM np WHERE p > 5.0
UNION ALL
SELECT CAST(1099511627776 AS BIGINT) AS flag_pos, 'class_imbalance' AS kind, 'income' AS column_name,
       printf('income: largest class %.2f times the smallest', ratio) AS flag
FROM ci WHERE ratio > 1.5""",
)
def quality_flags(spark, sf):
    return P.quality_flags(fx.gov_clean(spark, sf), "income", "classification")


@query(
    "quality_flags_regression",
    with_("gov_failing", _null_flag_sql("gov_failing"))
    + """, s AS (SELECT round(stddev_samp(total), 4) AS std, round(max(total), 4) - round(min(total), 4) AS range FROM gov_failing)
SELECT flag_pos, 'null_rate' AS kind, column_name, printf('%s: %.1f%% of the values are null', column_name, p) AS flag
FROM np WHERE p > 5.0
UNION ALL
SELECT CAST(1099511627776 AS BIGINT) AS flag_pos, 'regression_skew' AS kind, 'total' AS column_name,
       printf('total: range %.2f above three standard deviations of %.2f', range, std) AS flag
FROM s WHERE std > 0 AND range > 3 * std""",
)
def quality_flags_regression(spark, sf):
    return P.quality_flags(fx.gov_failing(spark, sf), "total", "regression")


# ---------------------------------------------------------------- PRJ-5
@query(
    "sensitive_hint",
    with_("gov")
    + """, names AS (SELECT DISTINCT w AS column_name FROM (
  SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(html, '[A-Za-z]+')) FROM pages
  UNION ALL SELECT column_name FROM (DESCRIBE SELECT * FROM gov))),
k AS (SELECT unnest(['gender', 'sex', 'race', 'ethnicity', 'nationality', 'religion', 'age', 'disability', 'marital',
                     'zip', 'postal', 'income', 'education', 'occupation']) AS word)
SELECT DISTINCT column_name, CAST(length(column_name) AS BIGINT) AS col_pos FROM names JOIN k ON contains(lower(column_name), word)""",
)
def sensitive_hint(spark, sf):
    """PRJ-5 over the governed table's columns and as many names as the
    documents and pages have words."""
    texts = fx.read(spark, sf, "documents").select("text").unionAll(fx.read(spark, sf, "pages").select("html"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("column_name"))
    words = words.unionAll(spark.createDataFrame([(c,) for c in fx.gov(spark, sf).columns], "column_name string")).distinct()
    return P.sensitive_hint(words.withColumn("col_pos", F.length("column_name").cast("long")))
