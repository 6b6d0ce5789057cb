"""Distributed building blocks against plain computations."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gavel.functions import scan, stats


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    cols = {
        "a": np.round(rng.exponential(3.0, 3000), 1),
        "b": rng.integers(0, 50, 3000).astype(float),
        "c": rng.normal(0, 1e9, 3000),
        "d": np.where(rng.random(3000) < 0.5, 0.0, 1.0),  # two values, each half
        "e": np.full(3000, 7.0),
    }
    rows = [tuple(float(cols[c][i]) for c in cols) + (None if i else 5.0, float("nan")) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "one", "none"])).repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    exprs = {c: F.col(c) for c in [*cols, "one", "none"]}
    for bracket in (10_000, 40):  # the small bracket forces the narrowing rounds
        monkeypatch.setattr(stats, "BRACKET", bracket)
        got = stats.exact_quantiles(df, exprs, probs)
        for c, arr in cols.items():
            assert got[c] == [np.quantile(arr, p) for p in probs], (c, bracket)
        assert got["one"] == [5.0] * 6 and got["none"] == [None] * 6


def test_exact_quantiles_with_infinities(spark):
    """As numpy at 5 and at 50,000 rows: ranks on infinite values, beside them,
    and interpolation that has no value."""
    inf, probs = float("inf"), [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for n in (5, 50_000):
        x = np.arange(n, dtype=float)
        cols = {
            "low": np.where(x < n // 5, -inf, x), "high": np.where(x >= n - 2 * n // 5, inf, x),
            "both": np.where(x % 3 == 0, -inf, np.where(x % 3 == 1, inf, x)), "all": np.full(n, inf), "none": x,
        }
        df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(n)], ", ".join(f"`{c}` double" for c in cols))
        got = stats.exact_quantiles(df, {c: F.col(f"`{c}`") for c in cols}, probs)
        for c, v in cols.items():
            with np.errstate(invalid="ignore"):
                # on a whole rank numpy adds 0 * inf of the next one, which has no value; the rank's own value stands here
                want = [np.quantile(v, p) if (n - 1) * p % 1 else np.sort(v)[int((n - 1) * p)] for p in probs]
            assert got[c] == [None if np.isnan(w) else w for w in want], (c, n)


def test_outliers_with_infinities(spark):
    from gavel.operators import profile as P

    inf = float("inf")
    rows = [(float(i), -inf if i < 10 else float(i), inf, inf if i < 20 else -inf) for i in range(41)] + [(-inf, inf, inf, 0.0)]
    got = {r.column_name: r.outliers for r in P.outliers_iqr(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}
    assert got == {"a": 1, "b": 11}


def test_weight_before_matches_window(spark):
    rows = [(g, float(v), int(w)) for g in ("x", "y") for v, w in zip(range(40), [1, 3, 2, 5] * 10)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    want = {(r["g"], r["v"]): r["b"] for r in df.select("g", "v", F.coalesce(F.sum("w").over(w), F.lit(0)).alias("b")).collect()}
    for parts in (1, 5):
        assert {(r["g"], r["v"]): r["before"] for r in stats.weight_before(df, "g", "v", "w", partitions=parts).collect()} == want


def test_chunked_scans_match_plain_windows(spark):
    rows = [(f"k{i % 3}", i, (i * 7) % 5 == 0, f"m{i}" if i % 4 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, flag boolean, val string")
    w_incl = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_prev = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "seq",
        F.sum(F.col("flag").cast("long")).over(w_incl).alias("cum"),
        F.last("val", ignorenulls=True).over(w_prev).alias("last"),
        F.lag("seq").over(Window.partitionBy("key").orderBy("seq")).alias("prev"),
    )
    d = scan.prefix_scan(df, "key", "seq", {"cum": F.col("flag")}, {"last": F.col("val")}, chunk=7)
    d = scan.previous_value(d, "key", "seq", "seq", "prev", chunk=7)
    got = {r["seq"]: (r["cum"], r["last"], r["prev"]) for r in d.collect()}
    exp = {r["seq"]: (r["cum"], r["last"], r["prev"]) for r in want.collect()}
    assert got == exp


def test_top_k_grouped_and_global(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, v long")
    g = stats.top_k(df, ["g"], [F.col("v").desc()], 2).collect()
    assert sorted((r["g"], r["v"]) for r in g) == [("a", 8), ("a", 9), ("b", 1), ("b", 2)]
    t = stats.top_k(df, [], [F.col("v").desc(), F.col("g")], 3).orderBy("rank").collect()
    assert [r["v"] for r in t] == [9, 8, 7]
