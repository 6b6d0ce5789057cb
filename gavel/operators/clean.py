"""Cleaning and encoding under a plan, the quality report and the gate.

Order (fixed): drop columns (PRJ-3) -> drop null-target rows (PRJ-4) ->
impute (CLN-1/2) -> label-encode the target (CLN-3) -> one-hot / frequency
encode (CLN-4/5) -> standard-scale (CLN-6) -> imbalance note (CLN-9) ->
quality report and gate (AGG-14/15).

Execution: a fit of few aggregate jobs whose results are small per-column
parameters (like Spark ML estimators), then one lazy projection.

* pass 1, raw table, one single-row aggregate: nulls of every column; for
  numeric features over the rows that keep their target: count, mean and
  population variance (merge-stable moments);
* medians of numeric features with gaps: bracketing aggregates (see
  ``stats.exact_quantiles``); the imputed column's mean and variance follow by
  the parallel-moments rule;
* pass 2, kept rows: the categorical value-count table (persisted): one
  aggregate gives nulls, cardinality, the mode (a bounded ``min_by``) and the
  power sums that give the moments of the frequency codes; one top-k job the
  one-hot vocabularies.

Frequency maps and the class list stay DataFrames and are joined (broadcast or
not is left to Spark's own size check, skew to AQE). Rows whose value was
imputed take the mode's share as a literal and stay out of the join key, so they
do not pile up on one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.exprs import as_text, col, is_flat, is_numeric, normalise_nan
from gavel.functions.stats import exact_quantiles, top_k, value_counts, weight_before

# Thresholds of the cleaning rules and the quality gate.
COLUMN_DROP_NULL_SHARE = 0.50      # drop a feature when its null share is above
HIGH_NULL_UNHANDLED_SHARE = 0.35   # gate fails when a kept feature had at least this
ROWS_DROPPED_LIMIT_PCT = 30.0      # gate fails at or above this share of dropped rows
ONE_HOT_CARDINALITY_LIMIT = 10     # one-hot below, frequency encoding at or above
MISSING_PCT_LIMIT = 5.0            # gate fails at or above this share of null cells
IMBALANCE_NOTE_RATIO = 1.5


@dataclass
class CleanFit:
    target: str
    task: str
    keys: tuple[str, ...]
    n_original: int
    original_nulls: dict[str, int]
    dropped: list[tuple[str, str]]            # (column, reason)
    rows_dropped: int
    kept: list[str]
    kinds: dict[str, str]                     # column -> numeric | bool | categorical
    impute_numeric: dict[str, tuple[float | None, int]] = field(default_factory=dict)
    impute_mode: dict[str, tuple[str | None, int]] = field(default_factory=dict)
    encode_target: bool = False
    n_classes: int = 0
    classes: DataFrame | None = None          # (value, code) of an encoded target
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    freq: dict[str, DataFrame] = field(default_factory=dict)
    freq_card: dict[str, int] = field(default_factory=dict)
    mode_share: dict[str, float] = field(default_factory=dict)  # share of the mode of an imputed, frequency-encoded column
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    imbalance_ratio: float | None = None
    smote: bool = False
    class_weight: bool = False
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Drop the persisted value-count tables (after the last transform)."""
        for d in self.cached:
            d.unpersist()


@dataclass
class CleanResult:
    cleaned: DataFrame
    report: DataFrame
    actions: DataFrame
    fit: CleanFit


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def _kind(dt: T.DataType, had_nulls: bool) -> str:
    if isinstance(dt, T.BooleanType):
        # a boolean column with gaps is a column of objects in the reference
        # data model: imputed by mode and encoded as text categories
        return "categorical" if had_nulls else "bool"
    if is_numeric(dt):
        return "numeric"
    return "categorical"


def refuse_nested(df: DataFrame, keys: tuple[str, ...] = ()) -> None:
    """Nested columns have no place in the cleaned table: name them instead of
    losing them."""
    nested = [f.name for f in df.schema.fields if not is_flat(f.dataType) and f.name not in keys]
    if nested:
        raise ValueError(f"nested columns cannot be cleaned, flatten or drop them first: {nested}")


def drop_columns(df: DataFrame, target: str, explicit: list[str] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-3 as a table: (column_name, col_pos, null_share, reason) of the
    features to drop: null share above 0.50 or named by the plan; never the
    target or a key. One aggregate pass."""
    cols = [f.name for f in df.schema.fields]
    agg = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(i).cast("long").alias("col_pos"),
                F.try_divide((F.col("__n") - F.col(f"c{i}")).cast("double"), F.col("__n").cast("double")).alias("null_share"),
                F.lit(c in set(explicit)).alias("explicit"),
            )
            for i, c in enumerate(cols)
            if c != target and c not in keys
        ]
    )
    long = agg.select(F.inline(rows))
    reason = F.when(F.col("explicit"), F.lit("named by the plan")).otherwise(
        F.format_string("%.1f%% null, above %.0f%%", F.col("null_share") * 100, F.lit(COLUMN_DROP_NULL_SHARE * 100))
    )
    return long.where(F.col("explicit") | (F.col("null_share") > COLUMN_DROP_NULL_SHARE)).select(
        "column_name", "col_pos", "null_share", reason.alias("reason")
    )


def drop_null_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """PRJ-4: (kept rows, one-row counts (rows_before, rows_dropped, rows_kept,
    rows_dropped_pct))."""
    kept = df.where(col(target).isNotNull())
    counts = df.agg(F.count(F.lit(1)).alias("rows_before"), F.count(col(target)).alias("rows_kept"))
    counts = counts.select(
        "rows_before",
        (F.col("rows_before") - F.col("rows_kept")).alias("rows_dropped"),
        "rows_kept",
        F.coalesce(F.round(F.try_divide((F.col("rows_before") - F.col("rows_kept")) * 100.0, F.col("rows_before").cast("double")), 2), F.lit(0.0)).alias("rows_dropped_pct"),
    )
    return kept, counts


def _modes(vc_cat: DataFrame) -> DataFrame:
    """(column_name, mode): most frequent non-null value, smallest on ties."""
    vals = vc_cat.where(F.col("value").isNotNull())
    return top_k(vals, ["column_name"], [F.col("n").desc(), F.col("value").asc()], 1).select("column_name", F.col("value").alias("mode"))


def _category_text(c: str, dt: T.DataType) -> Column:
    return as_text(c, dt)


# ---------------------------------------------------------------------------
# fit
# ---------------------------------------------------------------------------

def fit(
    df: DataFrame,
    target: str,
    task: str,
    explicit_drop: list[str] = (),
    keys: tuple[str, ...] = (),
    smote: bool = False,
    class_weight: bool = False,
) -> CleanFit:
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found; available: {df.columns}")
    if task not in ("classification", "regression"):
        raise ValueError(f"task must be 'classification' or 'regression', got {task!r}")
    refuse_nested(df, keys)
    df = normalise_nan(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(fields)

    # pass 1, one single-row aggregate over the raw table: nulls of every
    # column, and for numeric features over the rows that keep their target
    # (exactly the rows the row drop keeps): count, mean and population
    # variance (Spark's merge-stable moments)
    num_candidates = [c for c in cols if c != target and c not in keys and is_numeric(fields[c])]
    keep_row = col(target).isNotNull()
    exprs = [F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(cols)]]
    for i, c in enumerate(num_candidates):
        x = F.when(keep_row, col(c).cast("double"))
        exprs += [
            F.count(x).alias(f"kc{i}"),
            F.avg(x).alias(f"km{i}"),
            F.var_pop(x).alias(f"kv{i}"),
        ]
    r1 = df.agg(*exprs).first()
    n = int(r1["__n"])
    nulls = {c: n - int(r1[f"c{i}"]) for i, c in enumerate(cols)}
    kstats = {c: (int(r1[f"kc{i}"]), r1[f"km{i}"], r1[f"kv{i}"]) for i, c in enumerate(num_candidates)}

    dropped = []
    for c in cols:
        if c == target or c in keys:
            continue
        share = nulls[c] / n if n else 0.0
        if c in explicit_drop:
            dropped.append((c, "named by the plan"))
        elif share > COLUMN_DROP_NULL_SHARE:
            dropped.append((c, f"{share * 100:.1f}% null, above {COLUMN_DROP_NULL_SHARE * 100:.0f}%"))
    dropped_names = {c for c, _ in dropped}
    kept = [c for c in cols if c not in dropped_names]
    kinds = {c: _kind(fields[c], nulls[c] > 0) for c in kept if c != target and c not in keys}
    f = CleanFit(target, task, tuple(keys), n, nulls, dropped, nulls[target], kept, kinds, smote=smote, class_weight=class_weight)

    rows = df.where(keep_row)
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    cats = [c for c, k in kinds.items() if k == "categorical"]
    n_kept = n - f.rows_dropped

    # numeric features: medians of the columns with gaps, then mean and variance
    # of the imputed column by the parallel-moments rule
    need = [c for c in numeric if kstats[c][0] < n_kept]
    med = {c: q[0] for c, q in exact_quantiles(rows, {c: col(c) for c in need}, [0.5]).items()} if need else {}
    for c in numeric:
        cnt, mean, var = kstats[c]
        k = n_kept - cnt
        m = med.get(c)
        if k > 0:
            f.impute_numeric[c] = (m, k)
        if cnt == 0:
            f.scale[c] = (None, None)
            continue
        if k > 0 and m is not None:
            tot = cnt + k
            mi = (cnt * mean + k * m) / tot
            vi = (cnt * (var or 0.0) + cnt * (mean - mi) ** 2 + k * (m - mi) ** 2) / tot
            f.scale[c] = (mi, max(vi, 0.0) ** 0.5)
        else:
            f.scale[c] = (mean, max(var or 0.0, 0.0) ** 0.5)

    # pass 2: value counts of the categorical features (and of the target,
    # for classes and class balance) over the kept rows
    texts = {c: _category_text(c, fields[c]) for c in cats}
    vc_cols = list(cats)
    if task == "classification":
        texts[target] = col(target).cast("string")
        vc_cols.append(target)
    vc_cat = value_counts(rows, vc_cols, "string", texts).persist(StorageLevel.MEMORY_AND_DISK)
    f.cached = [vc_cat]

    card: dict[str, int] = {}
    if cats:
        cat_vc = vc_cat.where(F.col("column_name").isin(cats))
        val = F.col("value").isNotNull()
        nd = F.col("n").cast("double")
        # one aggregate: nulls, cardinality, mode (largest count, smallest
        # value: a bounded min_by) and the power sums that give the moments
        # of the frequency codes once the imputed rows join the mode
        stats = cat_vc.groupBy("column_name").agg(
            F.sum(F.when(~val, F.col("n")).otherwise(0)).alias("nulls"),
            F.count("value").alias("card"),
            F.min_by(F.col("value"), F.when(val, F.struct((-F.col("n")).alias("neg_n"), F.col("value")))).alias("mode"),
            F.max(F.when(val, F.col("n"))).alias("nmax"),
            F.sum(F.when(val, nd * nd)).alias("s2"),
            F.sum(F.when(val, nd * nd * nd)).alias("s3"),
        ).collect()
        moments = {}
        for r in stats:
            c = r["column_name"]
            card[c] = int(r["card"])
            if r["nulls"] > 0:
                f.impute_mode[c] = (r["mode"], int(r["nulls"]))
            moments[c] = r
        small = [c for c in cats if card.get(c, 0) < ONE_HOT_CARDINALITY_LIMIT]
        if small:
            # vocabularies: the first 10 values of each column (complete for
            # the one-hot columns, which have fewer than 10)
            vocab = top_k(cat_vc.where(F.col("column_name").isin(small) & val), ["column_name"], [F.col("value").asc()], ONE_HOT_CARDINALITY_LIMIT)
            got: dict[str, list[str]] = {c: [] for c in small}
            for r in vocab.select("column_name", "value").collect():
                got[r["column_name"]].append(r["value"])
            f.one_hot = {c: sorted(got[c]) for c in small}
        for c in cats:
            if c in f.one_hot:
                continue
            mode, filled = f.impute_mode.get(c, (None, 0))
            w = F.col("n") + F.when(F.col("value") == F.lit(mode), F.lit(filled)).otherwise(0)
            f.freq[c] = cat_vc.where((F.col("column_name") == c) & val).select(
                F.col("value").alias("__v"), (w.cast("double") / F.lit(float(n_kept))).alias("__f"), w.alias("__n")
            )
            f.freq_card[c] = card[c]
            r = moments[c]
            nmax, k, N = float(r["nmax"] or 0.0), float(filled if mode is not None else 0), float(n_kept)
            s2 = (r["s2"] or 0.0) - nmax * nmax + (nmax + k) ** 2
            s3 = (r["s3"] or 0.0) - nmax ** 3 + (nmax + k) ** 3
            if N and k:
                f.mode_share[c] = (nmax + k) / N
            mean_f = s2 / (N * N) if N else None
            var_f = max(s3 / N ** 3 - mean_f * mean_f, 0.0) if N else None
            f.scale[c] = (mean_f, var_f ** 0.5 if var_f is not None else None)

    # class balance from the target's value counts; classes other than numbers
    # and booleans are encoded by a joined table
    if task == "classification":
        of_target = vc_cat.where((F.col("column_name") == target) & F.col("value").isNotNull())
        b = of_target.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo")).first()
        f.n_classes = int(b["k"])
        f.encode_target = not is_numeric(fields[target]) and not isinstance(fields[target], T.BooleanType)
        if f.encode_target:
            f.classes = label_mapping(df, target)
        if b["k"] >= 2:
            f.imbalance_ratio = float(b["hi"]) / float(b["lo"])
    return f


def _imputed(f: CleanFit, c: str) -> Column:
    x = col(c).cast("double")
    if c in f.impute_numeric and f.impute_numeric[c][0] is not None:
        x = F.coalesce(x, F.lit(float(f.impute_numeric[c][0])))
    return x.alias(c)


# ---------------------------------------------------------------------------
# transform
# ---------------------------------------------------------------------------

def _scale(f: CleanFit, c: str, x: Column) -> Column:
    mean, std = f.scale[c]
    if mean is None:
        return x.alias(c)
    denom = std if std not in (None, 0.0) else 1.0
    return ((x - F.lit(float(mean))) / F.lit(float(denom))).alias(c)


def transform(df: DataFrame, f: CleanFit) -> DataFrame:
    """One projection over the kept rows (plus a join per frequency-encoded
    column)."""
    fields = {s.name: s.dataType for s in df.schema.fields}
    out = normalise_nan(df).where(col(f.target).isNotNull())
    # frequency maps: joined on the value; imputed rows take the mode's share
    for c, share in f.freq.items():
        m = share.select(F.col("__v").alias(f"__k_{c}"), F.col("__f").alias(f"__f_{c}"))
        out = out.withColumn(f"__key_{c}", _category_text(c, fields[c])).join(m, F.col(f"__key_{c}") == F.col(f"__k_{c}"), "left")
    if f.encode_target:
        codes = f.classes.select(F.col("value").alias("__class"), F.col("code").alias("__code"))
        out = out.join(codes, col(f.target) == F.col("__class"), "left")

    proj: list[Column] = []
    dummies: list[Column] = []
    for c in f.kept:
        if c in f.keys:
            proj.append(col(c))
            continue
        if c == f.target:
            proj.append(F.col("__code").alias(c) if f.encode_target else col(c))
            continue
        kind = f.kinds[c]
        if kind == "numeric":
            proj.append(_scale(f, c, _imputed(f, c)))
        elif kind == "bool":
            proj.append(col(c))
        elif c in f.one_hot:
            txt = _category_text(c, fields[c])
            mode, _ = f.impute_mode.get(c, (None, 0))
            v = F.coalesce(txt, F.lit(mode)) if mode is not None else txt
            for val in f.one_hot[c]:
                dummies.append(F.coalesce(v == F.lit(val), F.lit(False)).alias(f"{c}_{val}"))
        else:
            shared = F.lit(f.mode_share.get(c)).cast("double")
            proj.append(_scale(f, c, F.when(F.col(f"__key_{c}").isNull(), shared).otherwise(F.col(f"__f_{c}"))))
    return out.select(*proj, *dummies)


# ---------------------------------------------------------------------------
# report, actions, run
# ---------------------------------------------------------------------------

def quality_report(original: DataFrame, cleaned: DataFrame, f: CleanFit) -> DataFrame:
    """AGG-14/15: one row; the null figures come from a real pass over the
    cleaned table. List fields are arrays."""
    cols = cleaned.columns
    agg = cleaned.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    nulls = [(F.col("__n") - F.col(f"c{i}")) for i in range(len(cols))]
    null_cells = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    total = F.col("__n") * F.lit(len(cols))
    unresolved = F.filter(
        F.array(*[F.when(nulls[i] > 0, F.lit(c)) for i, c in enumerate(cols)]), lambda x: x.isNotNull()
    )
    n_orig = f.n_original
    unhandled = [
        f"{c} ({f.original_nulls[c] / n_orig * 100:.1f}% null)"
        for c in f.original_nulls
        if c != f.target and c not in {d for d, _ in f.dropped} and c not in f.keys and n_orig and f.original_nulls[c] / n_orig >= HIGH_NULL_UNHANDLED_SHARE
    ]
    ratio = F.lit(round(f.imbalance_ratio, 4) if f.imbalance_ratio is not None else None).cast("double")
    rows_pct = round(f.rows_dropped / n_orig * 100, 2) if n_orig else 0.0
    rep = agg.select(
        F.coalesce(F.round(F.try_divide(null_cells.cast("double") * 100.0, total.cast("double")), 4), F.lit(0.0)).alias("missing_pct_after_cleaning"),
        ratio.alias("class_balance_ratio"),
        F.lit(f.rows_dropped).cast("long").alias("rows_dropped"),
        F.lit(float(rows_pct)).alias("rows_dropped_pct"),
        F.array(*[F.lit(c) for c, _ in f.dropped]).cast("array<string>").alias("columns_dropped"),
        unresolved.cast("array<string>").alias("unresolved_null_columns"),
        F.array(*[F.lit(u) for u in unhandled]).cast("array<string>").alias("unhandled_high_null_columns"),
    )
    gate = (
        (F.col("missing_pct_after_cleaning") < MISSING_PCT_LIMIT)
        & (F.size("unresolved_null_columns") == 0)
        & (F.col("rows_dropped_pct") < ROWS_DROPPED_LIMIT_PCT)
        & (F.size("unhandled_high_null_columns") == 0)
    )
    return rep.withColumn("quality_check_passed", gate)


def _fmt_g4(x: float | None) -> str:
    return "nan" if x is None else f"{x:.4g}"


def actions(f: CleanFit, spark: SparkSession) -> DataFrame:
    """CLN-8: (seq, step, column_name, detail) built from the fitted
    parameters (one entry per decision, a few per column)."""
    out: list[tuple[str, str | None, str]] = [("drop_column", c, reason) for c, reason in f.dropped]
    if not f.dropped:
        out.append(("drop_column", None, "none"))
    if f.rows_dropped > 0:
        out.append(("drop_rows", f.target, f"rows={f.rows_dropped} share={f.rows_dropped / f.n_original:.3f}"))
    for c in f.kept:
        if c in f.impute_numeric:
            v, k = f.impute_numeric[c]
            out.append(("impute_median", c, f"median={_fmt_g4(v)} filled={k}"))
        elif c in f.impute_mode:
            v, k = f.impute_mode[c]
            out.append(("impute_mode", c, f"unresolved: no value among the kept rows, nulls={k}" if v is None else f"mode={v} filled={k}"))
    if f.encode_target:
        out.append(("label_encode", f.target, f"classes={f.n_classes}"))
    out += [("one_hot", c, f"columns={len(f.one_hot[c])}") for c in f.kept if c in f.one_hot]
    out += [("frequency_encode", c, f"values={f.freq_card[c]}") for c in f.kept if c in f.freq]
    scaled = [c for c in f.kept if c in f.scale]
    out.append(("scale", None, f"columns={','.join(scaled)}" if scaled else "none"))
    note = imbalance_note_text(f)
    if note:
        out.append(("imbalance_note", f.target, note))
    rows = [(i, s, c, d) for i, (s, c, d) in enumerate(out)]
    return spark.createDataFrame(rows, "seq long, step string, column_name string, detail string")


def imbalance_note_text(f: CleanFit) -> str | None:
    """CLN-9: note when the original target's ratio is above 1.5 or the plan
    mentions SMOTE / class weights (two classes or more)."""
    if f.task != "classification" or f.imbalance_ratio is None:
        return None
    if f.imbalance_ratio > IMBALANCE_NOTE_RATIO or f.smote or f.class_weight:
        return f"largest class {f.imbalance_ratio:.2f} times the smallest; resampling and weights are left to training"
    return None


def run(
    df: DataFrame,
    target: str,
    task: str,
    explicit_drop: list[str] = (),
    keys: tuple[str, ...] = (),
    smote: bool = False,
    class_weight: bool = False,
) -> CleanResult:
    """CLN-7: fit, transform, report and action log."""
    f = fit(df, target, task, explicit_drop, keys, smote, class_weight)
    cleaned = transform(df, f)
    return CleanResult(cleaned, quality_report(df, cleaned, f), actions(f, df.sparkSession), f)


# ---------------------------------------------------------------------------
# single-step operators (each a DataFrame, used by the named queries)
# ---------------------------------------------------------------------------

def _features(df: DataFrame, target: str, keys: tuple[str, ...]) -> dict[str, T.DataType]:
    refuse_nested(df, keys)
    return {f.name: f.dataType for f in df.schema.fields if f.name != target and f.name not in keys}


def median_table(df: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """CLN-1 fit: (column_name, median, nulls_filled) for numeric features
    with nulls among the rows whose target is present."""
    rows = df.where(col(target).isNotNull())
    nums = [c for c, dt in _features(df, target, keys).items() if is_numeric(dt)]
    if not nums:
        return df.sparkSession.createDataFrame([], "column_name string, median double, nulls_filled bigint")
    n = rows.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.nanvl(col(c).cast("double"), F.lit(None))).alias(f"c{i}") for i, c in enumerate(nums)]).first()
    gaps = {c: n["__n"] - n[f"c{i}"] for i, c in enumerate(nums) if n["__n"] > n[f"c{i}"]}
    med = exact_quantiles(rows, {c: col(c) for c in gaps}, [0.5]) if gaps else {}
    return df.sparkSession.createDataFrame([(c, med[c][0], k) for c, k in gaps.items()], "column_name string, median double, nulls_filled bigint")


def mode_table(df: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """CLN-2 fit: (column_name, mode, nulls_filled) for categorical features
    with nulls among the kept rows; mode NULL when no value is present."""
    rows = df.where(col(target).isNotNull())
    feats = _features(df, target, keys)
    cats = [c for c, dt in feats.items() if not is_numeric(dt) and not isinstance(dt, T.BooleanType)]
    vc = value_counts(rows, cats, "string", {c: as_text(c, feats[c]) for c in cats})
    nulls = vc.where(F.col("value").isNull()).select("column_name", F.col("n").alias("nulls_filled"))
    return nulls.join(_modes(vc), "column_name", "left").select("column_name", "mode", "nulls_filled")


def label_mapping(df: DataFrame, target: str) -> DataFrame:
    """CLN-3 / TRN-1 fit: (value, code) - sorted distinct classes -> 0..K-1, by
    a prefix count over range partitions of the distinct classes."""
    classes = df.where(col(target).isNotNull()).select(F.lit(0).alias("__g"), col(target).alias("value"), F.lit(1).alias("__one")).distinct()
    return weight_before(classes, "__g", "value", "__one").select("value", F.col("before").cast("long").alias("code"))


def one_hot_encode(df: DataFrame, cols: list[str], limit: int = ONE_HOT_CARDINALITY_LIMIT) -> DataFrame:
    """CLN-4: replace each string column with fewer than ``limit`` values by
    one boolean column per value (sorted, named ``col_value``), appended at
    the end. The vocabulary comes from one value-count job."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    vc = value_counts(df, cols, "string", {c: as_text(c, fields[c]) for c in cols}).where(F.col("value").isNotNull())
    vocab: dict[str, list[str]] = {}
    card = {r["column_name"]: r["k"] for r in vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("k")).collect()}
    small = [c for c in cols if card.get(c, 0) < limit]
    for r in vc.where(F.col("column_name").isin(small)).select("column_name", "value").collect():
        vocab.setdefault(r["column_name"], []).append(r["value"])
    keep = [col(c) for c in df.columns if c not in small]
    dummies = [
        F.coalesce(as_text(c, fields[c]) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in small
        for v in sorted(vocab.get(c, []))
    ]
    return df.select(*keep, *dummies)


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """CLN-5: value -> share of rows, via the value counts joined back on the
    value (nulls stay null and out of the join)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    out = df
    for c in cols:
        vc = value_counts(df, [c], "string", {c: as_text(c, fields[c])}).where(F.col("value").isNotNull())
        m = vc.select(F.col("value").alias(f"__k_{c}"), (F.col("n").cast("double") / n_rows).alias(f"__f_{c}"))
        out = out.join(m, as_text(c, fields[c]) == F.col(f"__k_{c}"), "left")
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in cols else col(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """CLN-6: (x - mean) / population std; a zero std divides by 1. The
    statistics are one single-row aggregate; the transform a projection."""
    exprs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        exprs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    st = df.agg(*exprs).first()  # one row of parameters
    proj = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            m, sd = st[f"m{i}"], st[f"s{i}"]
            sd = sd if sd not in (None, 0.0) else 1.0
            proj.append(((col(c).cast("double") - F.lit(m)) / F.lit(float(sd))).alias(c) if m is not None else col(c).cast("double").alias(c))
        else:
            proj.append(col(c))
    return df.select(*proj)
