"""Run every registered query in Spark and its DuckDB oracle side by side and
compare row count, column names/types and order-insensitive values.

    python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s = sdf.toPandas()
    ts = time.time() - t0
    res = {"name": name, "spark_rows": len(s), "spark_sec": round(ts, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d = con.sql(sql).df()
    res["oracle_rows"] = len(d)
    if sorted(s.columns) != sorted(d.columns):
        res["status"] = f"COLUMNS spark={sorted(s.columns)} oracle={sorted(d.columns)}"
        return res
    sch = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = {c: (sch[c], str(d[c].dtype)) for c in s.columns}
    res["types"] = dtypes
    if len(s) != len(d):
        res["status"] = "ROWCOUNT"
        return res
    rs, rd = rows_of(s), rows_of(d)
    bad = [(a, b) for a, b in zip(rs, rd) if a != b]
    res["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from gavel.plans import ORACLES, QUERIES
    from gavel.session import local_session

    spark = local_session()
    import os

    if os.environ.get("CHECK_TZ"):  # run with a non-UTC session time zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    con = duck(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            failed += 1
        types = r.pop("types", None)
        print(r, flush=True)
        if r["status"] != "ok" and types:
            print("   types:", types)
    print(f"FAILED {failed}")


if __name__ == "__main__":
    main(sys.argv)
