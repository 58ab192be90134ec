"""Records that do not fit, months of several layouts, and output that survives a failed write."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.catalog.crawl import crawl_directory
from tsukiori.operators.aggregate import retain_latest
from tsukiori.scratch import staged_counted
from tsukiori.sinks import files, writers
from tsukiori.sources import readers

PAIR = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])


def _rejects(checked):
    return sorted((r["record"], r["reasons"]) for r in checked.rejects.collect())


def test_csv_records_that_do_not_fit(spark, tmp_path):
    (tmp_path / "in.csv").write_text('B,A\n1.5,2\n3,4,5\n6\nx,7\n8,y\n,\n"","9"\n1e3,99999999999\nz,w\n')
    checked = readers.read_csv_checked(spark, str(tmp_path / "in.csv"), PAIR, known={})
    assert sorted(map(tuple, checked.rows.collect()), key=repr) == [(2, 1.5), (9, None), (None, None)]
    assert _rejects(checked) == [
        ("3,4,5", ["record"]),
        ("6", ["record"]),
        ('{"a":"7","b":"x"}', ["b"]),
        ('{"a":"99999999999","b":"1e3"}', ["a"]),
        ('{"a":"w","b":"z"}', ["a", "b"]),
        ('{"a":"y","b":"8"}', ["a"]),
    ]
    assert checked.rows.filter("a = 2").count() == 1 and checked.rejects.count() == 6
    plain = readers.read_csv_table(spark, str(tmp_path / "in.csv"), PAIR, known={})
    assert plain.count() == 9


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n")
    checked = readers.read_csv_checked(spark, str(tmp_path / "in.csv"), PAIR, known={})
    assert checked.rows.collect() == [] and checked.rejects.collect() == []


def test_json_lines_that_do_not_fit(spark, tmp_path):
    lines = ['{"a":1,"b":2.5}', '{"a":1,', "[1]", '{"a":"x","b":1}', "{}", '{"a":3,"more":1}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    checked = readers.read_json_checked(spark, str(tmp_path / "in.json"), PAIR)
    assert sorted(map(tuple, checked.rows.collect()), key=repr) == [(1, 2.5), (3, None), (None, None)]
    assert sorted(r["record"] for r in checked.rejects.collect()) == sorted(lines[1:4])


def test_months_of_several_layouts(spark, tmp_path):
    root = str(tmp_path / "t")
    declared = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    layouts = {
        "202401": spark.range(2).select(F.col("id").cast("int")),
        "202402": spark.range(2).select("id", F.lit("x").alias("Name"), F.lit(1).alias("extra")),
        "202403": spark.createDataFrame([("5", "y"), ("no", "z")], "id string, name string"),
        "202404": spark.range(1).select("id", F.lit("x").alias("name")),
    }
    for month, rows in layouts.items():
        writers.write_month_parquet(rows, root, month)
    read = readers.read_months_parquet(spark, root, declared)
    assert sorted(map(tuple, read.rows.collect()), key=repr) == sorted(
        [(0, None, "202401"), (1, None, "202401"), (0, "x", "202402"), (1, "x", "202402"), (5, "y", "202403"), (None, "z", "202403"), (0, "x", "202404")],
        key=repr,
    )
    assert read.findings == [
        ("202401", "id", "int"), ("202401", "name", "missing"), ("202402", "extra", "unknown"), ("202403", "id", "string"),
    ]
    some = readers.read_months_parquet(spark, root, declared, ["202404"])
    assert [tuple(r) for r in some.rows.collect()] == [(0, "x", "202404")] and some.findings == []
    assert readers.read_months_parquet(spark, str(tmp_path / "none"), declared).rows.collect() == []


def test_latest_months_without_reading_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    months = spark.createDataFrame([("202401", 1), ("202403", 2), ("202402", 3), (None, 4)], "yearmonth string, v int")
    writers.write_partitioned(months, root, ["yearmonth"])
    values = readers.partition_values(spark, root)
    assert values == ["202401", "202402", "202403"]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("latest", "latest")
    latest = retain_latest(spark.read.schema("v int, yearmonth string").parquet(root), 2, months=values)
    assert tracker.getJobIdsForGroup("latest") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["v"] for r in latest.collect()) == [2, 3]
    assert retain_latest(months, 2).count() == 2


def _failing(spark, columns="1 AS a"):
    return spark.range(3).selectExpr(columns, "cast(raise_error('lost') AS string) AS b")


@pytest.mark.parametrize("write", ["csv", "quoted", "replace", "sql"])
def test_a_failed_write_leaves_the_output(spark, tmp_path, write):
    path = str(tmp_path / "out" / "t")
    good = spark.range(10).selectExpr("1 AS a", "cast(id AS string) AS b")

    def put(rows):
        if write == "csv":
            writers.write_csv(rows, path)
        elif write == "quoted":
            writers.write_csv_quoted(rows, path)
        elif write == "replace":
            writers.write_partitioned(rows, path, ["a"], replace_all=True)
        else:
            rows.createOrReplaceTempView("to_publish")
            writers.sql_to_csv(spark, "SELECT * FROM to_publish", path)

    def count():
        return spark.read.parquet(path).count() if write == "replace" else readers.read_csv_text(spark, path).count()

    put(good)
    assert count() == 10
    with pytest.raises(Exception, match="lost"):
        put(_failing(spark))
    assert count() == 10
    put(good.limit(4))
    assert count() == 4
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["t"]


def test_a_swap_that_was_cut_short_is_repaired(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_csv(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / ".t.before")  # as left by a driver lost between two renames
    with pytest.raises(Exception, match="lost"):
        writers.write_csv(_failing(spark), path)
    writers.write_csv(spark.range(5), path)
    assert readers.read_csv_text(spark, path).count() == 5
    assert not (tmp_path / ".t.before").exists()


def test_a_rename_that_fails_puts_the_old_output_back(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("old")
    with pytest.raises(Exception):  # noqa: B017  there is nothing to rename
        files.publish(spark, str(tmp_path / "missing"), str(tmp_path / "t"))
    assert (tmp_path / "t" / "x").read_text() == "old"


def test_counts_of_the_job_that_writes(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 3 = 0, null, id) AS x", "id % 2 = 0 AS even")
    counts = {"n": F.count(F.lit(1)), "no x": F.count_if(F.col("x").isNull())}
    with staged_counted(rows, "counted", counts, ("even",)) as (written, seen):
        assert seen == {"n": 100, "no x": 34}
        assert written.count() == 100
    with staged_counted(rows.filter("id < 0"), "counted", counts) as (_, seen):
        assert seen == {"n": 0, "no x": 0}


def test_unchanged_files_are_not_crawled_again(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "one.csv").write_text("a,b\n1,x\n")
    (source / "two.csv").write_text("c\n2.5\n")
    first = crawl_directory(spark, str(source), "again", str(out))
    spark.sparkContext.setJobGroup("crawl", "crawl")
    second = crawl_directory(spark, str(source), "again", str(out), concurrent=1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("crawl")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert second == first and jobs == []
    (source / "one.csv").write_text("a,b\n1,x\n22,y\n")
    reader = spark.table("again.one")  # of the version before
    third = crawl_directory(spark, str(source), "again", str(out))
    assert third[0].location != first[0].location and third[1] == first[1]
    assert reader.collect() == [(1, "x")]
    assert spark.table("again.one").count() == 2
    manifest = json.loads((out / "_crawled" / "one.json").read_text())
    assert manifest["table"]["location"] == third[0].location


def test_the_table_is_there_at_any_time(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "one.csv").write_text("a\n1\n")
    crawl_directory(spark, str(source), "switched", str(out))
    statements = []
    run = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: statements.append(text) or run(self, text, *a, **k))
    for n in (2, 3, 4):
        (source / "one.csv").write_text("a\n" + "7\n" * n)
        crawl_directory(spark, str(source), "switched", str(out))
        assert spark.table("switched.one").count() == n
    assert not any("DROP" in s for s in statements) and sum("SET LOCATION" in s for s in statements) == 3
    versions = [p for p in (out / "one").iterdir() if p.name.startswith("version-")]
    assert len(versions) == 2
