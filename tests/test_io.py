"""Sources: CSV quoting, missing texts and malformed rows; stage tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from gavel.session import shared_path
from gavel.sources import events_io, io


def csv(spark, lines, suffix=".csv"):
    path = shared_path(spark, "tests", f"csv-{uuid.uuid4().hex}{suffix}")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_quotes_and_missing_texts(spark):
    got = io.read_table(spark, csv(spark, ["a,b,c,d", '"say ""hi"", ok",1,NA,True', "x,N/A,2.5,null", "None,3,nan,False"]))
    assert dict(got.dtypes) == {"a": "string", "b": "int", "c": "double", "d": "boolean"}
    assert [tuple(r) for r in got.collect()] == [('say "hi", ok', 1, None, True), ("x", None, 2.5, None), (None, 3, None, False)]


def test_long_numbers_and_empty_columns(spark):
    got = io.read_table(spark, csv(spark, ["a,b", "9007199254740993,", "1,"]))
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"} and got.first()["a"] == 9007199254740993


def test_malformed_rows_fail(spark):
    with pytest.raises(Exception):
        io.read_table(spark, csv(spark, ["a,b", "1,2,3"])).collect()
    for bad in ("bad,y,extra", "bad,y"):
        with pytest.raises(Exception):
            io.read_csv_named(spark, csv(spark, ["1,x", bad]), "n int, s string").collect()
    good = io.read_csv_named(spark, csv(spark, ["1, x", " ?,-"]), "n int, s string", na=("?", "-")).collect()
    assert [tuple(r) for r in good] == [(1, "x"), (None, None)]


def odd_csv(seed, rows):
    """Fields with line breaks, doubled and stray quotes, text after a closing
    quote, empty lines and both kinds of line end."""
    import random

    r = random.Random(seed)
    fields = ["", "x", 'a"b', "a b", '""', '"q"', '"say ""hi"""', '"two\nlines"', '"\n\n,"', '"a,b"', '"x"y', 'z""', '"""\n"""', '"ends\n"', "'", '"\n"", ""\n"']
    lines = ["n,a,b"]
    for k in range(rows):
        lines += [f"{k},{r.choice(fields)},{r.choice(fields)}"] + [""] * (r.random() < 0.1)
    return "\n".join(lines) + "\n"


def test_line_breaks_inside_quotes_by_many_tasks(spark):
    from gavel.sources import csv_records

    size, batch = "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = {k: spark.conf.get(k) for k in (size, batch)}
    for seed, lines, end in ((1, 3, "\n"), (2, 5, "\n"), (3, 10000, "\r\n")):
        path = csv(spark, odd_csv(seed, 300).replace("\n", end).removesuffix(end).split("\n"))
        want = spark.read.csv(path, header=True, mode="FAILFAST", quote='"', escape='"', multiLine=True)
        spark.conf.set(size, "700")
        spark.conf.set(batch, lines)
        try:
            assert spark.read.text(path).rdd.getNumPartitions() > 5
            got = csv_records.read(spark, path)
            assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)


def test_line_breaks_of_several_files_and_bad_rows(spark):
    path = shared_path(spark, "tests", f"csv-{uuid.uuid4().hex}.csv")
    spark.createDataFrame([(f"a,b\n{k},\"x\ny{k}\"",) for k in range(4)], "value string").repartition(4).write.text(path)
    got = io.read_table(spark, path, multi_line=True)
    assert dict(got.dtypes) == {"a": "int", "b": "string"}
    with pytest.raises(Exception):
        io.read_table(spark, csv(spark, ["a,b", '1,"2', '3",4']), multi_line=True).collect()
    assert io.read_table(spark, csv(spark, ["a,b"]), multi_line=True).count() == 0
    assert sum(r.b.startswith("x\ny") for r in got.collect()) == 4


def test_other_files_are_refused(spark):
    with pytest.raises(ValueError):
        io.read_table(spark, "/x/y.json")


def test_stage_tables_of_two_runs(spark):
    root = shared_path(spark, "tests", f"stages-{uuid.uuid4().hex}")
    io.save_stage(spark.range(5).selectExpr("id", "id a"), root, "1", "cleaned")
    io.save_stage(spark.range(3).selectExpr("id", "'z' z"), root, "01", "cleaned")
    io.save_stage(spark.range(2).selectExpr("id q"), root, "a/../b", "cleaned")
    assert io.load_stage(spark, root, "1", "cleaned").columns == ["id", "a"] and io.load_stage(spark, root, "1", "cleaned").count() == 5
    assert io.load_stage(spark, root, "01", "cleaned").columns == ["id", "z"] and io.load_stage(spark, root, "01", "cleaned").count() == 3
    assert io.load_stage(spark, root, "a/../b", "cleaned").count() == 2


def test_committed_log_of_several_writers(spark):
    """Writers side by side, a retried append and one without events: ids are
    unique and without gaps, and the rows of an append keep their order."""
    from concurrent.futures import ThreadPoolExecutor

    path = shared_path(spark, "tests", f"log-{uuid.uuid4().hex}")

    def rows(name, n):
        return events_io.new_events(spark, [(name, i, "planner_run", "automated", f"{name}-{i}", "{}") for i in range(n)])

    sizes = {f"w{k}": 3 + k for k in range(4)}
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(lambda w: events_io.commit_events(rows(w, sizes[w]), path, w), sizes))
    assert not events_io.commit_events(rows("w1", sizes["w1"]), path, "w1")
    assert not events_io.commit_events(rows("none", 0), path, "none")
    with ThreadPoolExecutor(3) as pool:  # three tries of one append at a time
        assert sorted(pool.map(lambda _: events_io.commit_events(rows("again", 5), path, "again"), range(3))) == [False, False, True]
    got = events_io.read_events(spark, path).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, sum(sizes.values()) + 5 + 1))
    for w, n in {**sizes, "again": 5}.items():
        mine = [r for r in got if r.run_id == w]
        assert [r.summary for r in mine] == [f"{w}-{i}" for i in range(n)]
        assert mine[-1].seq - mine[0].seq == n - 1
    big = spark.range(20_000).selectExpr("'big' AS run_id", "id AS seq", "timestamp_ntz'2024-01-01' AS ts", "'planner_run' AS event_type", "'automated' AS event_source", "cast(id AS string) AS summary", "'{}' AS details")
    assert events_io.commit_events(big.repartition(7), path, "big")
    base = len(got) + 1
    assert events_io.read_events(spark, path).where("run_id = 'big'").where(F.col("seq") - base != F.col("summary").cast("long")).count() == 0
    assert events_io.read_events(spark, path).select("seq").distinct().count() == len(got) + 20_000


def test_inferred_kinds_equal_the_casts_and_cost_no_failed_ones(spark):
    texts = ["1", "+1", "-5", "007", "1.", "1.5", ".5", "-.5e3", "1E+5", "1d", "0x1p3", "NaN", "-nan", "inf", "+INFINITY", "infi", "true", "FALSE", "t",
             "2147483647", "2147483648", "9223372036854775808", "\t5", "5\t", "\x7f5", "1995-01-01", "5-LOW", "-", ".", "1e", "1_000", "\u0663", "1e400", "x"]
    v = F.col("v")
    want = F.when(v.try_cast("int").isNotNull(), 1).when(v.try_cast("bigint").isNotNull(), 2).when(F.lower(v).isin("true", "false"), 0).when(v.try_cast("double").isNotNull(), 3).otherwise(4)
    rows = spark.createDataFrame([(x,) for x in texts], "v string")
    assert [r for r in rows.select("v", want.alias("a"), io._kind(v).alias("b")).collect() if r.a != r.b] == []
    got = io._with_types(spark.createDataFrame([("\x7f5", "\x7f5"), ("1.5", "2")], "a string, b string"))
    assert dict(got.dtypes) == {"a": "string", "b": "int"}
