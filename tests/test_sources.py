import pytest

from tests import fixtures
from tsukiori import names, schemas
from tsukiori.errors import ContractError, SourceNotFoundError
from tsukiori.sources import readers


def test_known_table_has_declared_types(spark, tmp_path):
    path = fixtures.write_csv(tmp_path / "ap.csv", fixtures.AP_HEADER, fixtures.AP_ROWS)
    df = readers.read_csv_table(spark, path, schemas.ACCESS_POINT)
    assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.ACCESS_POINT.fields]
    first = df.filter("apid = '02:4f:9a:10:c3:7e'").first()
    assert (first["latitude"], first["start_time"], first["yearmonth"]) == (
        36.238654, "2024/03/04 08:15", "202403",
    )


def test_header_decides_not_position(spark, tmp_path):
    order = [5, 0, 4, 1, 3, 2]
    path = fixtures.write_csv(
        tmp_path / "c.csv",
        ["﻿yearmonth", "APID"] + [fixtures.CONNECTION_HEADER[i] for i in order[2:]],
        [[row[i] for i in order] for row in fixtures.CONNECTION_ROWS],
    )
    df = readers.read_csv_table(spark, path, schemas.CONNECTION)
    assert df.columns == schemas.CONNECTION.fieldNames()
    assert {tuple(r) for r in df.collect()} == {
        tuple(cell or None for cell in row) for row in fixtures.CONNECTION_ROWS
    }


def test_blank_cells_are_null(spark, tmp_path):
    path = fixtures.write_csv(tmp_path / "c.csv", ["a", "b"], [["", "x"], ["y", ""]])
    assert {tuple(r) for r in readers.read_csv_text(spark, path).collect()} == {
        (None, "x"), ("y", None),
    }


def test_missing_and_surplus_columns(spark, tmp_path):
    short = fixtures.write_csv(
        tmp_path / "s.csv", fixtures.CONNECTION_HEADER[1:], [r[1:] for r in fixtures.CONNECTION_ROWS]
    )
    long = fixtures.write_csv(
        tmp_path / "l.csv", [*fixtures.CONNECTION_HEADER, "extra"],
        [[*r, "x"] for r in fixtures.CONNECTION_ROWS],
    )
    for path in (short, long):
        with pytest.raises(ContractError):
            readers.read_csv_table(spark, path, schemas.CONNECTION)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    fixtures.write_csv(tmp_path / "d" / "1.csv", ["a", "b"], [["1", "2"]])
    fixtures.write_csv(tmp_path / "d" / "2.csv", ["b", "a"], [["2", "1"]])
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv_text(spark, str(tmp_path / "d")).collect()


def test_value_of_the_wrong_type_is_null(spark, tmp_path):
    rows = [[*fixtures.AP_ROWS[0]]]
    rows[0][7] = "north"
    path = fixtures.write_csv(tmp_path / "ap.csv", fixtures.AP_HEADER, rows)
    df = readers.read_csv_table(spark, path, schemas.ACCESS_POINT)
    assert df.first()["latitude"] is None


def test_unquoted_master(spark, tmp_path):
    path = fixtures.write_csv(
        tmp_path / "u.csv", fixtures.USER_HEADER, fixtures.USER_ROWS, quoted=False
    )
    df = readers.read_csv_table(spark, path, schemas.USER_MASTER, names.USER_MASTER_NAMES)
    assert df.columns == ["operator_user_attr", "common_user_attr", "label_ja"]
    assert df.count() == len(fixtures.USER_ROWS)


def test_headerless_csv(spark, tmp_path):
    path = fixtures.write_csv(tmp_path / "h.csv", ["1", "2"], [["3", "4"]])
    assert sorted(map(tuple, readers.read_csv_text(spark, path, header=False).collect())) == [
        ("1", "2"), ("3", "4"),
    ]


def test_partition_column_of_csv_directories_is_text(spark, tmp_path):
    for month in ("202403", "202404"):
        fixtures.write_csv(tmp_path / "t" / f"yearmonth={month}" / "x.csv", ["a"], [[month]])
    df = readers.read_csv_text(spark, str(tmp_path / "t"))
    assert df.dtypes == [("a", "string"), ("yearmonth", "string")]
    assert {tuple(r) for r in df.collect()} == {("202403", "202403"), ("202404", "202404")}


def test_month_of_parquet_lists_one_directory(spark, tmp_path):
    root = str(tmp_path / "p")
    spark.createDataFrame([(1, "202403"), (2, "202404")], "v int, yearmonth string").write.partitionBy(
        "yearmonth"
    ).parquet(root)
    month = readers.read_month_parquet(spark, root, "202404")
    assert [tuple(r) for r in month.collect()] == [(2, "202404")]
    assert month.dtypes[-1] == ("yearmonth", "string")
    assert all("yearmonth=202404" in f for f in month.inputFiles())


def test_first_available(spark, tmp_path):
    path = fixtures.write_csv(tmp_path / "x.csv", ["a"], [["1"]])
    df = readers.read_first_available(spark, [str(tmp_path / "no"), path])
    assert df.first()["a"] == "1"
    with pytest.raises(SourceNotFoundError):
        readers.read_first_available(spark, [str(tmp_path / "no")])


def test_rows_to_df(spark):
    df = readers.rows_to_df(spark, [["a", "b"]], schemas.STATUS_MASTER)
    assert df.first().asDict() == {"operator_status": "a", "common_status": "b"}


def test_a_location_that_does_not_load_is_passed_over(spark, tmp_path):
    other = fixtures.write_csv(tmp_path / "other.csv", ["x"], [["1"]])
    good = fixtures.write_csv(tmp_path / "good.csv", fixtures.STATUS_HEADER, fixtures.STATUS_ROWS)

    def read(session, path):
        return readers.read_csv_table(session, path, schemas.STATUS_MASTER, names.STATUS_MASTER_NAMES)

    assert readers.read_first_available(spark, [other, good], read).count() == len(fixtures.STATUS_ROWS)
    with pytest.raises(SourceNotFoundError, match="missing columns"):
        readers.read_first_available(spark, [other], read)


def test_cells_as_a_csv_library_writes_them(spark, tmp_path):
    rows = [['say "hi", you', "1"], ["back\\slash", "2"], [" blanks ", "3"], ["two\nlines", "4"]]
    path = fixtures.write_csv(tmp_path / "t.csv", ["a", "b"], rows, quoted=False)
    assert sorted(map(tuple, readers.read_csv_text(spark, path, multi_line=True).collect())) == sorted(map(tuple, rows))
