"""DuckDB oracle building blocks: the fixture tables as CTE text over the
pre-registered parquet views. Written independently of the Spark code so
that the oracle checks it rather than mirrors it."""

from __future__ import annotations

GOV = """gov AS (
  SELECT o.o_orderkey AS order_id, c.c_mktsegment AS segment,
         CASE WHEN o.o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         r.r_name AS region, n.n_name AS nation, o.o_orderpriority AS priority,
         c.c_acctbal AS balance, o.o_totalprice AS total,
         o.o_totalprice * 0.07 + c.c_acctbal AS fee,
         CAST(extract(year FROM o.o_orderdate) AS INTEGER) AS order_year,
         (o.o_orderkey % 7 = 0) AS express,
         CASE WHEN o.o_totalprice > CASE WHEN o.o_custkey % 2 = 0 THEN 400000 ELSE 330000 END
              THEN '>50K' ELSE '<=50K' END AS income
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

GOV_CLEAN = """gov_clean AS (
  SELECT order_id, segment, gender, region, nation,
         CASE WHEN order_id % 100 < 6 THEN NULL ELSE priority END AS priority,
         CASE WHEN order_id % 100 BETWEEN 10 AND 14 THEN NULL ELSE balance END AS balance,
         total, fee, order_year, express, income
  FROM gov)"""

GOV_FAILING = """gov_failing AS (
  SELECT order_id,
         CASE WHEN (order_id * 7 + 1) % 100 < 60 THEN NULL ELSE segment END AS segment,
         gender, region,
         CASE WHEN (order_id * 7 + 3) % 100 < 60 THEN NULL ELSE nation END AS nation,
         CASE WHEN (order_id * 7 + 2) % 100 < 60 THEN NULL ELSE priority END AS priority,
         balance, total, fee, order_year, express,
         CASE WHEN order_id % 100 < 35 THEN NULL ELSE income END AS income
  FROM gov)"""

GOV_FIXABLE = """gov_fixable AS (
  SELECT order_id, segment, gender, region, nation,
         CASE WHEN order_id % 100 < 42 THEN NULL ELSE priority END AS priority,
         balance, total, fee, order_year, express, income
  FROM gov)"""

VARIANTS = {"gov": [GOV], "gov_clean": [GOV, GOV_CLEAN], "gov_failing": [GOV, GOV_FAILING], "gov_fixable": [GOV, GOV_FIXABLE]}

# (name, spark dtype name, numeric in the profile sense, boolean)
GOV_COLUMNS = [
    ("order_id", "bigint", True, False),
    ("segment", "string", False, False),
    ("gender", "string", False, False),
    ("region", "string", False, False),
    ("nation", "string", False, False),
    ("priority", "string", False, False),
    ("balance", "double", True, False),
    ("total", "double", True, False),
    ("fee", "double", True, False),
    ("order_year", "int", True, False),
    ("express", "boolean", False, True),
    ("income", "string", False, False),
]
NUMERIC = [c for c, _, num, _ in GOV_COLUMNS if num]
CATEGORICAL = [c for c, _, num, _ in GOV_COLUMNS if not num]


def with_(variant: str, *extra: str) -> str:
    """WITH clause for a fixture variant plus extra CTEs."""
    return "WITH " + ",\n".join([*VARIANTS[variant], *extra]) + "\n"


def text(c: str) -> str:
    """Category text as the Spark side renders it (booleans True/False)."""
    booleans = {n for n, _, _, b in GOV_COLUMNS if b}
    if c in booleans:
        return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} THEN 'True' ELSE 'False' END"
    return f"CAST({c} AS VARCHAR)"


def long_values(table: str, cols: list[str], numeric: bool) -> str:
    """UNION ALL unpivot (column_name, value) of a fixture table."""
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)" if numeric else text(c)
        parts.append(f"SELECT '{c}' AS column_name, {v} AS value FROM {table}")
    return "\nUNION ALL\n".join(parts)
