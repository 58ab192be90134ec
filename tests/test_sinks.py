import csv

import pytest
from pyspark.sql import functions as F

from tsukiori.errors import MonthError
from tsukiori.sinks import files, writers
from tsukiori.sources.readers import read_csv_text


def _months(spark, *months):
    return spark.createDataFrame([(m, i) for i, m in enumerate(months)], "yearmonth string, v int")


def _read(spark, path):
    df = spark.read.schema("v int, yearmonth string").parquet(path)
    return sorted((r["yearmonth"], r["v"]) for r in df.collect())


def test_other_months_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitioned(_months(spark, "202501", "202502"), path, ["yearmonth"])
    again = spark.createDataFrame([(9,)], "v int")
    writers.write_month_parquet(again, path, "202502")
    assert _read(spark, path) == [("202501", 0), ("202502", 9)]
    writers.write_month_parquet(again, path, "202502", replace_all=True)
    assert _read(spark, path) == [("202502", 9)]


@pytest.mark.parametrize("codec", ["snappy", "uncompressed"])
def test_compression(spark, tmp_path, codec):
    path = str(tmp_path / "t")
    writers.write_partitioned(_months(spark, "202501"), path, ["yearmonth"], compression=codec)
    (folder,) = (tmp_path / "t").glob("yearmonth=*")
    (part,) = folder.glob("part-*")
    assert (".snappy." in part.name) == (codec == "snappy")


def test_rebalance_splits_one_large_month(spark, tmp_path):
    df = spark.range(200_000).select(
        F.lit("202501").alias("yearmonth"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
    try:
        writers.write_partitioned(df, path, ["yearmonth"], rebalance=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "yearmonth=202501").glob("part-*"))) > 1
    assert spark.read.parquet(path).count() == 200_000


def test_csv_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_partitioned(_months(spark, "202501"), path, ["yearmonth"], format="csv")
    assert spark.read.option("header", True).csv(path).columns == ["v", "yearmonth"]


def test_single_csv_is_one_file_of_that_name(spark, tmp_path):
    df = spark.createDataFrame([("é,\"x\"", 1.5, None)], "s string, d double, n string")
    path = writers.write_month_csv(df, str(tmp_path), "202501", single_file=True)
    assert path.endswith("/list_ap_table/listap202501.csv")
    with open(path, encoding="utf-8", newline="") as f:
        lines = list(csv.reader(f))
    assert lines == [["s", "d", "n"], ["é,\"x\"", "1.5", ""]]
    assert [p.name for p in (tmp_path / "list_ap_table").iterdir() if p.name[0] != "."] == [
        "listap202501.csv"
    ]


ODD_TEXTS = ["plain", 'a"b', '"', "a,b", "a\\b", "a,\\", "\\", " padded ", "　全角　", "x" * 5000]


@pytest.mark.parametrize("single", [False, True])
def test_csv_keeps_texts_as_they_are(spark, tmp_path, single):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "i int, t string")
    writers.write_csv(df.coalesce(1), str(tmp_path / "x.csv"), single_file=single)
    target = tmp_path / "x.csv"
    (part,) = target.glob("part-*") if target.is_dir() else [target]
    with open(part, encoding="utf-8", newline="") as f:
        rows = sorted(list(csv.reader(f))[1:])
    assert [r[1] for r in rows] == ODD_TEXTS


def test_either_layout_replaces_the_other(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    for rows, single in ((3, False), (4, True), (5, True), (6, False)):
        writers.write_csv(spark.range(rows), path, single_file=single)
        assert (tmp_path / "x.csv").is_dir() != single
        assert spark.read.option("header", True).csv(path).count() == rows
        assert [p.name for p in tmp_path.iterdir() if p.name[0] != "."] == ["x.csv"]


def test_the_number_of_rows_does_not_decide_a_layout(spark, tmp_path):
    for rows in (0, 1, 100):
        path = str(tmp_path / f"{rows}.csv")
        writers.write_csv(spark.range(rows), path)
        assert (tmp_path / f"{rows}.csv").is_dir()


def test_a_failed_write_leaves_no_parts(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        writers.write_csv(bad, str(tmp_path / "x.csv"), single_file=True)
    assert list(tmp_path.iterdir()) == []


def test_the_library_reads_what_it_publishes(spark, tmp_path):
    texts = [*ODD_TEXTS, "two\nlines", 'both "\n', " \n "]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "i string, t string")
    for single in (False, True):
        path = str(tmp_path / f"{single}.csv")
        writers.write_csv(df, path, single_file=single)
        back = read_csv_text(spark, path, multi_line=True)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_backups_are_kept_by_number(spark, tmp_path):
    root = str(tmp_path)
    for month in ("202412", "202501", "202502"):
        writers.write_backup_csv(spark.range(1), root, month)
    folder = f"{root}/list_ap_backup"
    files.move(spark, writers.write_month_csv(spark.range(1), root, "202501"), f"{folder}/other.csv")
    assert writers.drop_old_backups(spark, folder, "202502", 2) == ["backup_listap202412.csv"]
    writers.write_backup_csv(spark.range(1), root, "202503", keep=1)
    assert files.list_names(spark, folder) == ["backup_listap202503.csv", "other.csv"]


def test_a_late_backup_is_kept(spark, tmp_path):
    root = str(tmp_path)
    for month, keep in (("202501", 1), ("202412", 1), ("202502", 2), ("202411", 2)):
        path = writers.write_backup_csv(spark.range(1), root, month, keep=keep, single_file=True)
        assert files.exists(spark, path)
    assert files.list_names(spark, f"{root}/list_ap_backup") == ["backup_listap202411.csv", "backup_listap202502.csv"]
    with pytest.raises(ValueError, match="kept"):
        writers.write_backup_csv(spark.range(1), root, "202412", keep=0)


def test_lists_of_other_months_go_on_demand(spark, tmp_path):
    root = str(tmp_path)
    for month, all_ in (("202412", False), ("202501", False), ("202411", True)):
        writers.write_month_csv(spark.range(1), root, month, replace_all=all_)
        names = files.list_names(spark, f"{root}/list_ap_table")
    assert names == ["listap202411.csv"]


def test_connection_csv_replaces_other_months_only_on_demand(spark, tmp_path):
    root = str(tmp_path / "c")
    writers.write_connection_csv(spark.range(1), root, "202501")
    writers.write_connection_csv(spark.range(2), root, "202502")
    assert files.list_names(spark, root) == ["yearmonth=202501", "yearmonth=202502"]
    path = writers.write_connection_csv(spark.range(3), root, "202503", replace_all=True)
    assert path.endswith("yearmonth=202503/connection_data.csv")
    assert files.list_names(spark, root) == ["yearmonth=202503"]


def test_every_cell_is_quoted(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("", "b")], "x string, y string")
    writers.write_csv_quoted(df.coalesce(1), str(tmp_path / "q"))
    (part,) = (tmp_path / "q").glob("part-*")
    assert part.read_text().splitlines() == ['"x","y"', '"a",""', '"","b"']


def test_sql_to_csv_returns_and_writes_all(spark, tmp_path):
    path = str(tmp_path / "out")
    assert writers.sql_to_csv(spark, "select id from range(50)", path).count() == 50
    assert spark.read.option("header", True).csv(path).count() == 50
    assert writers.sql_to_csv(spark, "select id from range(50)").count() == 50


def test_sql_to_csv_gives_the_same_with_and_without_a_file(spark, tmp_path):
    query = "select * from values (1, ''), (2, null), (3, 'a\\nb'), (4, ' ') as t(i, x)"
    frames = [writers.sql_to_csv(spark, query, path) for path in (None, str(tmp_path / "out"))]
    plain, written = [sorted(map(tuple, f.collect())) for f in frames]
    assert plain == written


def test_month_is_checked_before_writing(spark, tmp_path):
    for write in (writers.write_month_csv, writers.write_backup_csv, writers.write_connection_csv,
                  writers.write_month_parquet):
        with pytest.raises(MonthError):
            write(spark.range(1), str(tmp_path / "m"), "2025/1")
    assert not (tmp_path / "m").exists()


def test_missing_directory_has_no_names(spark, tmp_path):
    assert files.list_names(spark, str(tmp_path / "none")) == []
    assert not files.exists(spark, str(tmp_path / "none"))
