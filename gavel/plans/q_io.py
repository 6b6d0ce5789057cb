"""Source/sink queries (SRC-1, SRC-2, SRC-3, SRC-7): tables written to the
shared folder by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.operators import clean as C
from gavel.plans.q_clean import _clean_run_cte, _dummies_sql, _ohe_cols, _round_doubles, _run_scaled, _scaled_sql
from gavel.plans.registry import query
from gavel.plans.sql import with_
from gavel.session import shared_path
from gavel.sources import fixtures as fx
from gavel.sources import io

def _fresh(spark, *parts: str) -> str:
    return shared_path(spark, *parts, uuid.uuid4().hex)


def _as_gov_types(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema.fields])


# ---------------------------------------------------------------- SRC-1
@query("src_csv_roundtrip", with_("gov") + "SELECT * FROM gov")
def src_csv_roundtrip(spark, sf):
    g = fx.gov(spark, sf)
    path = _fresh(spark, "csv", "gov") + ".csv"
    io.write_csv(g, path)
    back = io.read_table(spark, path)
    return _as_gov_types(back, g)


# Texts that a careless reader changes: quotes, separators, missing markers.
_ODD_SQL = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'say "' || source || '", ok' WHEN 1 THEN source || ', ' || lang
       WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '"' ELSE source END AS name,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS size,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS even FROM documents"""


@query(
    "src_csv_inferred_types",
    f"""WITH odd AS ({_ODD_SQL})
SELECT * FROM (SELECT 'doc_id' AS column_name, CASE WHEN max(doc_id) < 2147483648 THEN 'int' ELSE 'bigint' END AS inferred_type FROM odd
UNION ALL SELECT 'name', CASE WHEN count(try_cast(name AS DOUBLE)) < count(name) THEN 'string' END FROM odd
UNION ALL SELECT 'size', CASE WHEN max(size) < 2147483648 THEN 'int' ELSE 'bigint' END FROM odd
UNION ALL SELECT 'even', CASE WHEN count(even) > 0 THEN 'boolean' END FROM odd)""",
)
def src_csv_inferred_types(spark, sf):
    """SRC-1 type inference in spite of missing-value texts."""
    back = io.read_table(spark, _odd_csv(spark, sf))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in back.schema.fields], "column_name string, inferred_type string")


def _odd_csv(spark, sf) -> str:
    """A CSV of doubled quotes, separators in fields and missing-value texts,
    written as plain lines (no CSV writer takes part)."""
    d = fx.read(spark, sf, "documents")
    k = F.col("doc_id")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit('"say ""'), "source", F.lit('"", ok"')))
        .when(k % 6 == 1, F.concat(F.lit('"'), "source", F.lit(", "), "lang", F.lit('"')))
        .when(k % 6 == 2, F.lit("NA")).when(k % 6 == 3, F.lit("")).when(k % 6 == 4, F.lit('""""')).otherwise(F.col("source"))
    )
    size = F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string"))
    even = F.when(k % 7 == 0, F.lit("None")).when(k % 2 == 0, F.lit("True")).otherwise(F.lit("false"))
    lines = d.select(F.concat_ws(",", k.cast("string"), name, size, even).alias("value"))
    path = _fresh(spark, "csv") + ".csv"
    # every file starts with the header, as a CSV folder has it
    head = lines.mapInArrow(_with_header("doc_id,name,size,even"), "value string")
    head.write.text(path)
    return path


@query(
    "src_csv_line_breaks",
    "SELECT doc_id, CASE WHEN trim(t) = '' THEN NULL ELSE t END AS text, lang FROM (SELECT *, replace(text, chr(13), ' ') AS t FROM documents)",
)
def src_csv_line_breaks(spark, sf):
    """SRC-1 over whole texts with line breaks, quotes and separators, written
    as plain lines."""
    d = fx.read(spark, sf, "documents")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = d.select(F.concat_ws(",", F.col("doc_id").cast("string"), F.coalesce(quoted, F.lit("")), F.coalesce("lang", F.lit(""))).alias("value"))
    path = _fresh(spark, "csv") + ".csv"
    lines.mapInArrow(_with_header("doc_id,text,lang"), "value string").write.text(path)
    back = io.read_table(spark, path, multi_line=True)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _with_header(header):
    def add(batches):
        import pyarrow as pa

        for i, batch in enumerate(batches):
            if not i:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    return add


@query("src_csv_quoting", f"SELECT doc_id, name, size, coalesce(CAST(even AS VARCHAR), 'missing') AS even FROM ({_ODD_SQL})")
def src_csv_quoting(spark, sf):
    """SRC-1 reading: quoting and missing-value texts, value by value."""
    back = io.read_table(spark, _odd_csv(spark, sf))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "name", F.col("size").cast("long").alias("size"), F.coalesce(F.col("even").cast("string"), F.lit("missing")).alias("even"))


# ---------------------------------------------------------------- SRC-2
@query("src_csv_na_markers", with_("gov_clean") + "SELECT * FROM gov_clean")
def src_csv_na_markers(spark, sf):
    g = fx.gov_clean(spark, sf)
    path = _fresh(spark, "csv", "gov_na")
    # header-less, nulls written as ' ?' (a blank after the separator)
    g.write.mode("overwrite").option("header", False).option("nullValue", " ?").option("ignoreLeadingWhiteSpace", False).csv(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.schema.fields)
    return io.read_csv_named(spark, path, schema, na=("?",))


# ---------------------------------------------------------------- SRC-3
@query(
    "stage_table_roundtrip",
    with_("gov_clean", _clean_run_cte)
    + "SELECT e.order_id, "
    + ", ".join(_scaled_sql(c, f"e.{c}") for c in _run_scaled)
    + ", e.express, CAST((SELECT code FROM lab WHERE lab.v = e.income) AS BIGINT) AS income, "
    + ", ".join(d for c in _ohe_cols for d in _dummies_sql(c, f"e.{c}"))
    + " FROM enc e, st",
)
def stage_table_roundtrip(spark, sf):
    root = _fresh(spark, "stages")
    res = C.run(fx.gov_clean(spark, sf), "income", "classification", keys=("order_id",))
    io.save_stage(res.cleaned, root, "run-a", "cleaned")
    res.fit.release()
    return _round_doubles(io.load_stage(spark, root, "run-a", "cleaned"))


@query(
    "stage_two_runs",
    """SELECT '1' AS run_id, 'o_custkey,o_orderkey' AS columns, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders
UNION ALL SELECT '01', 'p_size', count(*), sum(p_size)::BIGINT FROM part""",
)
def stage_two_runs(spark, sf):
    """Two runs with look-alike ids and different columns in one root."""
    root = _fresh(spark, "stages")
    io.save_stage(fx.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), root, "1", "cleaned")
    io.save_stage(fx.read(spark, sf, "part").select("p_size"), root, "01", "cleaned")
    out = None
    for run_id, c in (("1", "o_custkey"), ("01", "p_size")):
        back = io.load_stage(spark, root, run_id, "cleaned")
        part = back.agg(F.lit(run_id).alias("run_id"), F.lit(",".join(sorted(back.columns))).alias("columns"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("total"))
        out = part if out is None else out.union(part)
    return out


# ---------------------------------------------------------------- SRC-7
@query("preview_top10", with_("gov") + "SELECT * FROM gov ORDER BY order_id LIMIT 10")
def preview_top10(spark, sf):
    return io.preview(fx.gov(spark, sf), "order_id", 10)
