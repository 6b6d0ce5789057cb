"""Audit the physical plans of the registered queries.

For each query: number of shuffles (Exchange), broadcasts, nested-loop or
cartesian joins, windows, Python operators and parquet scans with their
read schema width. Prints one line per query and a summary.

    python tools/plan_audit.py [sf_dir] [name ...]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

PATTERNS = {
    "exchange": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
    "broadcast": r"BroadcastExchange",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "window": r"\bWindow \[",
    "group_limit": r"WindowGroupLimit",
    "python": r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|FlatMapGroupsInPandasWithState)",
    "scan": r"FileScan parquet",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def audit(name: str, df) -> dict:
    txt = plan_text(df)
    out = {k: len(re.findall(p, txt)) for k, p in PATTERNS.items()}
    widths = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", txt)]
    out["max_read_cols"] = max(widths) if widths else 0
    out["pushed_filters"] = len(re.findall(r"PushedFilters: \[[^\]]+\]", txt))
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from gavel.plans import QUERIES
    from gavel.session import local_session

    spark = local_session()
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = audit(name, fn(spark, sf))
        except Exception as e:  # report and go on
            r = {"error": f"{type(e).__name__}: {str(e)[:200]}"}
        print(name, r, flush=True)


if __name__ == "__main__":
    main(sys.argv)
