"""Distributed statistics building blocks.

``value_counts``: the central intermediate ``vc(column, value, n)``. One
unpivot + one groupBy gives cardinality, mode, top-k, frequency maps, one-hot
vocabularies and class balance for every column at once. The groupBy is
partially aggregated map-side, so a hot value (one value holding a third of
all rows) collapses to one row per map task before the shuffle.

``exact_quantiles``: exact linear-interpolation quantiles of many columns by
narrowing brackets - single-row aggregates only, no shuffle of data rows and no
value map in one task (as Spark's ``percentile`` / ``median`` would build).

``top_k``: ``row_number() <= k`` per group; Catalyst turns the filter into a
partial ``WindowGroupLimit`` before the shuffle, so each group ships at most
k rows per map partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, isnan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.exprs import col


def long_form(df: DataFrame, cols: Sequence[str], value_type: str, text_cols: dict[str, Column] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (column, value) rows, values cast to one type."""
    text_cols = text_cols or {}
    proj = [(text_cols[c] if c in text_cols else col(c)).cast(value_type).alias(f"v{i}") for i, c in enumerate(cols)]
    wide = df.select(*proj)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("value")) for i, c in enumerate(cols)])
    return wide.select(F.inline(pairs))


def value_counts(df: DataFrame, cols: Sequence[str], value_type: str = "string", text_cols: dict[str, Column] | None = None) -> DataFrame:
    """(column, value, n) including a NULL-value row per column with nulls."""
    if not cols:
        spark = df.sparkSession
        return spark.createDataFrame([], f"column_name string, value {value_type}, n bigint")
    return long_form(df, cols, value_type, text_cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group with a 1-based rank. Grouped: the rank filter
    becomes a partial WindowGroupLimit below the shuffle. Global: a
    TakeOrderedAndProject (k rows per task), ranked afterwards."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
    return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))


def pinned(ranged: DataFrame) -> DataFrame:
    """Materialise a frame once. A ranged frame feeds two
    branches (partition totals and the in-partition ranks); re-running the
    range partitioning per branch may sample different bounds, so the ids
    are pinned by a reliable checkpoint in the shared checkpoint folder
    (which also cuts the lineage and survives executor loss)."""
    from gavel.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(ranged.sparkSession)
    return ranged.checkpoint(eager=True)


# values of a bracket that one aggregate may hold, and the sketch's accuracy
BRACKET = 10_000
ACCURACY = 1_000


def _lerp(lo: float, hi: float, t: float) -> float:
    """numpy's linear interpolation (the form used for quantiles)."""
    d = hi - lo
    return hi - d * (1.0 - t) if t >= 0.5 else lo + d * t


def exact_quantiles(df: DataFrame, cols: dict[str, Column], probs: Sequence[float], chunk: int = 100) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation between order statistics, as numpy
    computes them) of several numeric expressions; NULL and NaN are left out. An
    infinite value is a value like others; where interpolation between or with
    infinite values has no value (numpy: NaN), the quantile is None.

    Nothing but single rows is shuffled. One aggregate counts the values and the
    infinite ones, which settles the ranks that fall on those; then, while the wanted order statistic's bracket holds more than ``BRACKET``
    values, a mergeable quantile sketch of the bracket's interior names a
    narrower one (about 1/150 of it) and an exact count tells where the
    statistic lies; the last aggregate sorts the few values left. So the number
    of scans is logarithmic in the rows, for all columns together."""
    x = {c: F.nanvl(e.cast("double"), F.lit(None).cast("double")) for c, e in cols.items()}

    def scan(exprs: dict[str, Column]) -> dict:
        """One single-row aggregate a chunk of columns."""
        got, names = {}, list(exprs)
        for at in range(0, len(names), chunk):
            part = names[at : at + chunk]
            row = df.agg(*[exprs[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
            got.update({n: row[f"a{i}"] for i, n in enumerate(part)})
        return got

    inf = float("inf")
    first = scan({(c, i): e for c, v in x.items() for i, e in enumerate((F.count(v), F.count_if(v == F.lit(-inf)), F.count_if(v == F.lit(inf))))})
    n, under, over = ({c: first[c, i] for c in x} for i in range(3))
    wanted = {(c, r) for c in x if n[c] for p in probs for r in (floor((n[c] - 1) * p), ceil((n[c] - 1) * p))}
    found: dict[tuple[str, int], float] = {(c, r): -inf for c, r in wanted if r < under[c]} | {(c, r): inf for c, r in wanted if r >= n[c] - over[c]}
    # (column, rank) -> open interval (lo, hi), values up to lo, values inside
    state = {k: (-inf, inf, under[k[0]], n[k[0]] - under[k[0]] - over[k[0]]) for k in wanted if k not in found}

    def inside(c: str, lo: float, hi: float) -> Column:
        return F.when((x[c] > F.lit(lo)) & (x[c] < F.lit(hi)), x[c])

    while wide := {k: v for k, v in state.items() if k not in found and v[3] > BRACKET}:
        at = {}
        for (c, r), (lo, hi, before, m) in wide.items():
            q = (r - before + 0.5) / m
            at[c, r] = F.percentile_approx(inside(c, lo, hi), F.array(*[F.lit(min(max(q + d, 0.0), 1.0)) for d in (-3 / ACCURACY, 3 / ACCURACY)]), F.lit(ACCURACY))
        edges = scan(at)
        counts = scan({(k, i): e for k, (a, b) in edges.items() for i, e in enumerate((
            F.count_if(inside(k[0], state[k][0], a).isNotNull()), F.count_if(x[k[0]] == F.lit(a)),
            F.count_if(inside(k[0], a, b).isNotNull()), F.count_if(x[k[0]] == F.lit(b))))})
        for k, (a, b) in edges.items():
            lo, hi, before, m = state[k]
            below, at_a, mid, at_b = (counts[k, i] for i in range(4))
            at_b = 0 if a == b else at_b
            r = k[1] - before
            if r < below:
                state[k] = (lo, a, before, below)
            elif r < below + at_a:
                found[k] = a
            elif r < below + at_a + mid:
                state[k] = (a, b, before + below + at_a, mid)
            elif r < below + at_a + mid + at_b:
                found[k] = b
            else:
                done = below + at_a + mid + at_b
                state[k] = (b, hi, before + done, m - done)
    left = scan({k: F.array_sort(F.collect_list(inside(k[0], v[0], v[1]))) for k, v in state.items() if k not in found})
    found.update({k: values[k[1] - state[k][2]] for k, values in left.items()})
    out: dict[str, list[float | None]] = {}
    for c in x:
        out[c] = []
        for p in probs:
            if not n[c]:
                out[c].append(None)
                continue
            pos = (n[c] - 1) * p
            q = _lerp(found[c, floor(pos)], found[c, ceil(pos)], pos - floor(pos)) if pos % 1 else found[c, floor(pos)]
            out[c].append(None if isnan(q) else q)
    return out


def weight_before(df: DataFrame, group: str, value: str, weight: str, partitions: int | None = None) -> DataFrame:
    """Add ``before`` = sum of ``weight`` over rows of the same ``group``
    with a strictly smaller ``value`` (rows hold distinct (group, value)).

    A distributed prefix sum: range-partition by (group, value), total each
    range partition (a table of partitions x groups rows), prefix-sum those
    totals, then a window inside each range partition only - never over a
    whole group."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = pinned(df.repartitionByRange(parts, group, value).withColumn("__pid", F.spark_partition_id()))
    pstats = ranged.groupBy(group, "__pid").agg(F.sum(weight).alias("__cnt"))
    pstats = pstats.select(
        group, "__pid",
        (F.sum("__cnt").over(Window.partitionBy(group).orderBy("__pid")) - F.col("__cnt")).alias("__off"),
    )
    within = Window.partitionBy(group, "__pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("__cum", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    out = out.join(pstats, [group, "__pid"])
    return out.withColumn("before", F.col("__off") + F.col("__cum")).drop("__pid", "__off", "__cum")
