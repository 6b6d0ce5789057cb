"""Profiling (EDA) operators: summary, per-column profile, numeric stats, IQR
outliers, top categories, correlations, target analysis, planner facts and
quality flags.

Plan shape: one wide single-row aggregate for counts and moments (partial
aggregation map-side, nothing shuffled but one row per task), bracketing
aggregates for exact quantiles, and the value-count table for what needs the
values themselves (top-k). Windows only run over aggregated frames or with a
``row_number() <= k`` limit that Catalyst pushes below the shuffle.
"""

from __future__ import annotations

from math import isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.exprs import (
    as_text,
    categorical_columns,
    col,
    contains_any,
    dtype_name,
    is_numeric,
    numeric_columns,
    pct,
    profileable,
)
from gavel.functions.stats import exact_quantiles, top_k, value_counts

# Keywords that make a column name look like a sensitive attribute.
SENSITIVE_KEYWORDS = [
    "gender", "sex", "race", "ethnicity", "nationality", "religion",
    "age", "disability", "marital", "zip", "postal", "income",
    "education", "occupation",
]

# Thresholds of the planner's quality flags.
NULL_FLAG_PCT = 5.0
IMBALANCE_FLAG_RATIO = 1.5
IQR_FACTOR = 1.5
HISTOGRAM_MIN_DISTINCT = 15


# ---------------------------------------------------------------------------
# column-level facts
# ---------------------------------------------------------------------------

def _column_meta(df: DataFrame) -> list[tuple[int, str, T.DataType]]:
    return [(i, f.name, f.dataType) for i, f in enumerate(profileable(df))]


def column_nulls(df: DataFrame) -> DataFrame:
    """(column, col_pos, dtype, is_numeric, n_rows, null_count): one pass."""
    meta = _column_meta(df)
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(f"c{i}") for i, c, _ in meta])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(i).cast("long").alias("col_pos"),
                F.lit(dtype_name(dt)).alias("dtype"),
                F.lit(is_numeric(dt)).alias("is_numeric"),
                F.col("__n").alias("n_rows"),
                (F.col("__n") - F.col(f"c{i}")).alias("null_count"),
            )
            for i, c, dt in meta
        ]
    )
    return agg.select(F.inline(rows))


def categorical_value_counts(df: DataFrame) -> DataFrame:
    fields = {f.name: f.dataType for f in profileable(df)}
    cats = categorical_columns(df)
    return value_counts(df, cats, "string", {c: as_text(c, fields[c]) for c in cats})


def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, cardinality): distinct non-null values per column. Exact: the
    values of each column's own type, as text, are made distinct together (one
    shuffle for all columns, combined map-side); ``approx`` uses HLL++ in a
    single aggregate pass."""
    meta = _column_meta(df)
    names = F.array(*[F.lit(c) for _i, c, _t in meta])
    if approx:
        agg = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c, _ in meta])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").cast("long").alias("cardinality")) for i, c, _ in meta])
        return agg.select(F.inline(rows))

    def own_text(c: str, dt: T.DataType) -> Column:
        x = col(c)  # 0.0 + x makes the two zeros of floating types one
        return (x + F.lit(0.0).cast(dt)).cast("string") if isinstance(dt, (T.FloatType, T.DoubleType)) else x.cast("string")

    cells = F.array(*[F.struct(F.lit(k).alias("k"), own_text(c, dt).alias("value")) for k, (_i, c, dt) in enumerate(meta)])
    seen = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    return seen.groupBy("k").agg(F.count(F.lit(1)).alias("cardinality")).select(F.element_at(names, F.col("k") + 1).alias("column_name"), "cardinality")


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """AGG-2: (column, col_pos, dtype, null_count, null_pct, cardinality, is_numeric)."""
    nulls = column_nulls(df)
    card = cardinality(df, approx)
    return nulls.join(card, "column_name", "left").select(
        "column_name",
        "col_pos",
        "dtype",
        "null_count",
        F.coalesce(pct(F.col("null_count"), F.col("n_rows"), 2), F.lit(0.0)).alias("null_pct"),
        F.coalesce(F.col("cardinality"), F.lit(0).cast("long")).alias("cardinality"),
        "is_numeric",
    )


def profile_numeric(df: DataFrame) -> DataFrame:
    """AGG-3: min/max/mean/sample std per numeric column, 4 dp; NULL when the
    column is all null."""
    nums = numeric_columns(df)
    pos = {c: i for i, c, _ in _column_meta(df)}
    if not nums:
        return df.sparkSession.createDataFrame([], "column_name string, col_pos bigint, min double, max double, mean double, std double")
    exprs = []
    for i, c in enumerate(nums):
        x = col(c).cast("double")
        exprs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    agg = df.agg(*exprs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(pos[c]).cast("long").alias("col_pos"),
                F.round(F.col(f"mn{i}"), 4).alias("min"),
                F.round(F.col(f"mx{i}"), 4).alias("max"),
                F.round(F.col(f"av{i}"), 4).alias("mean"),
                F.round(F.col(f"sd{i}"), 4).alias("std"),
            )
            for i, c in enumerate(nums)
        ]
    )
    return agg.select(F.inline(rows))


def iqr_bounds(df: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """column -> (q1, q3, lower, upper) from exact quartiles, for the numeric
    columns with both quartiles (two numbers a column, kept on the driver). A
    bound that is undefined, as between infinite quartiles, is None: no value is
    outside it."""
    def bound(x: float) -> float | None:
        return None if isnan(x) else x

    q = exact_quantiles(df, {c: col(c) for c in numeric_columns(df)}, [0.25, 0.75])
    return {c: (a, b, bound(a - IQR_FACTOR * (b - a)), bound(b + IQR_FACTOR * (b - a))) for c, (a, b) in q.items() if a is not None and b is not None}


def outlier_counts(df: DataFrame) -> DataFrame:
    """(column, q1, q3, lower, upper, outliers) for every numeric column with
    at least one value: one single-row aggregate once the bounds are known."""
    bounds = iqr_bounds(df)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column_name string, q1 double, q3 double, lower double, upper double, outliers bigint")
    outside = [F.count_if((col(c).cast("double") < F.lit(lo).cast("double")) | (col(c).cast("double") > F.lit(hi).cast("double"))).alias(f"o{i}") for i, (c, (_a, _b, lo, hi)) in enumerate(bounds.items())]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"), F.col(f"o{i}").alias("outliers"))
        for i, (c, (q1, q3, lo, hi)) in enumerate(bounds.items())
    ])
    return df.agg(*outside).select(F.inline(rows))


def outliers_iqr(df: DataFrame) -> DataFrame:
    """AGG-4: columns with at least one IQR outlier."""
    return outlier_counts(df).where(F.col("outliers") > 0)


def top_categories(df: DataFrame, k: int = 5, vc_cat: DataFrame | None = None) -> DataFrame:
    """AGG-5: (column, rank, value, n) - top-k non-null values per categorical
    column by count desc, value asc."""
    vc_cat = vc_cat if vc_cat is not None else categorical_value_counts(df)
    vals = vc_cat.where(F.col("value").isNotNull())
    return top_k(vals, ["column_name"], [F.col("n").desc(), F.col("value").asc()], k).select(
        "column_name", F.col("rank").cast("long").alias("rank"), "value", "n"
    )


def pearson_pairs(df: DataFrame) -> DataFrame:
    """(pair_pos, feature_a, feature_b, r) for all numeric column pairs,
    pairwise-complete rows, NULL where a side is constant or < 2 rows.

    Two scans whatever the number of columns: the minima (values are shifted by
    them, which keeps the sums well-conditioned and constants at zero), and one
    pass in which every task adds up its matrices of products over Arrow
    batches. A task hands on one row a column; a column's rows are added up
    together (tasks x columns numbers)."""
    nums = numeric_columns(df)
    k = len(nums)
    spark = df.sparkSession
    if k < 2:
        return spark.createDataFrame([], "pair_pos bigint, feature_a string, feature_b string, r double")
    x = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(nums)])
    low = x.agg(*[F.min(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    shifted = x.select(*[(F.col(f"x{i}") - F.lit(float(low[i] or 0.0))).alias(f"x{i}") for i in range(k)])
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((len(sums), k, k))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = (~np.isnan(v)).astype(float)
            v = np.nan_to_num(v)
            q = v * v
            total += np.stack([there.T @ there, v.T @ there, there.T @ v, q.T @ there, there.T @ q, v.T @ v])
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32())] + [pa.array(list(t), pa.list_(pa.float64())) for t in total], names=["a", *sums])

    def finish(table):
        import numpy as np
        import pyarrow as pa

        a = table.column("a")[0].as_py()
        n, sa, sb, saa, sbb, sab = (np.stack([np.asarray(x) for x in table.column(c).to_pylist()]).sum(axis=0)[a + 1 :] for c in sums)
        many = np.maximum(n, 1)
        va, vb, cov = saa - sa * sa / many, sbb - sb * sb / many, sab - sa * sb / many
        ok = (n >= 2) & (va > 1e-12 * saa) & (vb > 1e-12 * sbb)
        r = cov / np.sqrt(np.where(ok, va * vb, 1.0))
        b = np.arange(a + 1, k)
        place = a * (2 * k - a - 1) // 2 + b - a - 1
        return pa.table({"pair_pos": pa.array(place, pa.int64()), "a": pa.array(np.full(len(b), a), pa.int32()), "b": pa.array(b, pa.int32()), "r": pa.array(r, pa.float64(), mask=~ok)})

    parts = shifted.mapInArrow(add_up, "a int, " + ", ".join(f"{c} array<double>" for c in sums))
    names = F.array(*[F.lit(c) for c in nums])
    pairs = parts.groupBy("a").applyInArrow(finish, "pair_pos bigint, a int, b int, r double")
    return pairs.select("pair_pos", F.element_at(names, F.col("a") + 1).alias("feature_a"), F.element_at(names, F.col("b") + 1).alias("feature_b"), "r")


def correlations_top(df: DataFrame, min_abs: float = 0.20, k: int = 10) -> DataFrame:
    """AGG-6: (rank, feature_a, feature_b, correlation) - |r| >= min_abs
    (unrounded), ordered by |rounded r| desc then pair order, top k, 4 dp.
    The window runs over the k(k-1)/2 pair rows only."""
    r = pearson_pairs(df).where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= min_abs))
    r = r.withColumn("correlation", F.round("r", 4))
    return top_k(r, [], [F.abs("correlation").desc(), F.col("pair_pos").asc()], k).select(
        F.col("rank").cast("long").alias("rank"), "feature_a", "feature_b", "correlation"
    )


def summary(df: DataFrame) -> DataFrame:
    """AGG-1: one row of dataset-level counts."""
    nulls = column_nulls(df)
    n_outlier_cols = outliers_iqr(df).agg(F.count(F.lit(1)).alias("k"))
    s = nulls.agg(
        F.max("n_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("null_count").cast("long").alias("missing_cells"),
        F.sum(F.col("is_numeric").cast("int")).cast("long").alias("numeric_columns_count"),
        F.sum((~F.col("is_numeric")).cast("int")).cast("long").alias("categorical_columns_count"),
    )
    total_cells = F.col("total_rows") * F.col("total_columns")
    return s.select(
        F.coalesce(F.col("total_rows"), F.lit(0).cast("long")).alias("total_rows"),
        "total_columns",
        F.coalesce(F.col("missing_cells"), F.lit(0).cast("long")).alias("missing_cells"),
        F.coalesce(total_cells - F.col("missing_cells"), F.lit(0).cast("long")).alias("clean_cells"),
        F.coalesce(pct(F.col("missing_cells"), total_cells, 2), F.lit(0.0)).alias("missing_pct"),
        "numeric_columns_count",
        "categorical_columns_count",
        n_outlier_cols.scalar().alias("outlier_columns_count"),
    )


# ---------------------------------------------------------------------------
# target analysis
# ---------------------------------------------------------------------------

def _target_is_numeric(df: DataFrame, target: str) -> bool:
    return is_numeric(df.schema[target].dataType)


def target_histogram(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """AGG-7: (bin, label, lo, hi, n) over the non-null numeric target with
    more than 15 distinct values: equal-width bins over [min, max], the last
    one closed, edges as a linear space so that bin membership matches the
    reference histogram exactly. Empty when the rule does not apply.

    min / max / distinct estimate are three scalars of one small job; binning
    is then a map-side projection and the count a partially aggregated
    groupBy on at most ``bins`` keys."""
    spark = df.sparkSession
    schema = "bin bigint, label string, lo double, hi double, n bigint"
    if not _target_is_numeric(df, target):
        return spark.createDataFrame([], schema)
    x = col(target).cast("double")
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull())
    st = vals.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.approx_count_distinct("v").alias("nd")).first()
    # the sketch errs by a few per cent: far above the limit it decides, near it
    # the values are few enough to be made distinct
    few = st["nd"] < 10 * HISTOGRAM_MIN_DISTINCT
    if few and vals.distinct().count() <= HISTOGRAM_MIN_DISTINCT:
        return spark.createDataFrame([], schema)
    mn, mx = float(st["mn"]), float(st["mx"])
    e0, e1 = (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)
    step = (e1 - e0) / bins
    edges = [e0 + i * step for i in range(bins)] + [e1]

    def edge(i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(e) for e in edges]), i.cast("int") + 1)

    b0 = F.least(F.floor((F.col("v") - F.lit(e0)) * F.lit(bins / (e1 - e0))).cast("int"), F.lit(bins - 1))
    binned = vals.select("v", b0.alias("b0"))
    down = F.col("v") < edge(F.col("b0"))
    up = (F.col("v") >= edge(F.col("b0") + 1)) & (F.col("b0") != bins - 1)
    b = (F.col("b0") - down.cast("int") + up.cast("int")).cast("long").alias("bin")
    counts = binned.groupBy(b).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left").select(
        "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n")
    )
    return out.select("bin", F.format_string("%.2f - %.2f", "lo", "hi").alias("label"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


def target_numeric_stats(df: DataFrame, target: str) -> DataFrame:
    """AGG-8: min/max/mean/std/bias-corrected skew of a numeric target, 4 dp."""
    x = col(target).cast("double")
    a = df.agg(
        F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("g1"), F.count(x).alias("n"),
    )
    n = F.col("n").cast("double")
    adj = F.when(F.col("n") >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return a.select(
        F.round("mn", 4).alias("min"), F.round("mx", 4).alias("max"), F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"), F.round(adj, 4).alias("skew"),
    )


def target_class_counts(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """AGG-9: (rank, value, n, unique_classes) - top-k classes of the target."""
    t = as_text(target, df.schema[target].dataType)
    vc = df.select(t.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    classes = vc.agg(F.count(F.lit(1))).scalar()
    return top_k(vc, [], [F.col("n").desc(), F.col("value").asc()], k).select(
        F.col("rank").cast("long").alias("rank"), "value", "n", classes.cast("long").alias("unique_classes")
    )


def chart_missingness(df: DataFrame) -> DataFrame:
    """AGG-10: (kind, cells) for the clean/missing chart."""
    s = summary_counts(df)
    return s.select(F.inline(F.array(
        F.struct(F.lit("clean").alias("kind"), F.col("clean_cells").alias("cells")),
        F.struct(F.lit("missing").alias("kind"), F.col("missing_cells").alias("cells")),
    )))


def summary_counts(df: DataFrame) -> DataFrame:
    nulls = column_nulls(df)
    s = nulls.agg(F.max("n_rows").alias("r"), F.count(F.lit(1)).alias("c"), F.sum("null_count").cast("long").alias("missing_cells"))
    return s.select((F.col("r") * F.col("c") - F.col("missing_cells")).alias("clean_cells"), "missing_cells")


def chart_correlation(df: DataFrame) -> DataFrame:
    """AGG-10: (rank, label, correlation) with 'a vs b' labels."""
    c = correlations_top(df)
    return c.select("rank", F.concat_ws(" vs ", "feature_a", "feature_b").alias("label"), "correlation")


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """AGG-11: (n_classes, imbalance_ratio, balance_ratio): largest / smallest
    class count; planner form 2 dp and 1.0 under two classes, report form 4 dp
    and NULL under two classes."""
    vc = df.where(col(target).isNotNull()).groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    a = vc.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    ratio = F.col("hi").cast("double") / F.col("lo").cast("double")
    return a.select(
        F.col("k").cast("long").alias("n_classes"),
        F.when(F.col("k") >= 2, F.round(ratio, 2)).otherwise(F.lit(1.0)).alias("imbalance_ratio"),
        F.when(F.col("k") >= 2, F.round(ratio, 4)).alias("balance_ratio"),
    )


def regression_skew(df: DataFrame, target: str) -> DataFrame:
    """AGG-12: target stats rounded to 4 dp and the severe-skew flag."""
    x = col(target).cast("double")
    a = df.agg(
        F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"),
        F.round(F.min(x), 4).alias("min"), F.round(F.max(x), 4).alias("max"),
    )
    rng = F.col("max") - F.col("min")
    return a.select(
        "mean", "std", "min", "max", rng.alias("range"),
        F.coalesce((F.col("std") > 0) & (rng > 3 * F.col("std")), F.lit(False)).alias("severe_skew"),
    )


def quality_flags(df: DataFrame, target: str, task: str) -> DataFrame:
    """AGG-13: (flag_pos, kind, column, flag) in planner order: one flag per
    column with more than 5.0 % nulls, then the class-imbalance flag
    (classification) or the severe-skew flag (regression)."""
    nulls = column_nulls(df).select(
        "column_name", "col_pos", F.try_divide(F.col("null_count") * 100.0, F.col("n_rows").cast("double")).alias("p")
    )
    null_flags = nulls.where(F.col("p") > NULL_FLAG_PCT).select(
        F.col("col_pos").alias("flag_pos"),
        F.lit("null_rate").alias("kind"),
        "column_name",
        F.format_string("%s: %.1f%% of the values are null", F.col("column_name"), F.col("p")).alias("flag"),
    )
    big = F.lit(1 << 40).cast("long")
    if task == "classification":
        ci = class_imbalance(df, target)
        tflag = ci.where(F.col("imbalance_ratio") > IMBALANCE_FLAG_RATIO).select(
            big.alias("flag_pos"),
            F.lit("class_imbalance").alias("kind"),
            F.lit(target).alias("column_name"),
            F.format_string("%s: largest class %.2f times the smallest", F.lit(target), F.col("imbalance_ratio")).alias("flag"),
        )
    else:
        rs = regression_skew(df, target)
        tflag = rs.where(F.col("severe_skew")).select(
            big.alias("flag_pos"),
            F.lit("regression_skew").alias("kind"),
            F.lit(target).alias("column_name"),
            F.format_string("%s: range %.2f above three standard deviations of %.2f", F.lit(target), F.col("range"), F.col("std")).alias("flag"),
        )
    return null_flags.unionByName(tflag)


def sensitive_hint(profile: DataFrame) -> DataFrame:
    """PRJ-5: columns whose lower-cased name holds a sensitive keyword; works
    on any table with (column, col_pos), e.g. the column profile."""
    name = F.lower(F.col("column_name"))
    return profile.where(contains_any(name, SENSITIVE_KEYWORDS)).select("column_name", "col_pos")
