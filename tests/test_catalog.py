import pytest

from tests import fixtures
from tsukiori.catalog.crawl import crawl_directory, ddl_script
from tsukiori.catalog.types import infer_column_types
from tsukiori.errors import ContractError

CELLS = {
    "int": (["1", "-20", "007"], "INT"),
    "wide": (["1", "12345678901"], "BIGINT"),
    "too_wide": (["1", "1234567890123456789012"], "STRING"),
    "decimal": (["1.5", "-0.25", "3"], "DOUBLE"),
    "point_only": ([".5", "1."], "STRING"),
    "exponent": (["1e5"], "STRING"),
    "signed": (["+1"], "STRING"),
    "date": (["2025-01-01", "2025/1/1"], "STRING"),
    "blank": (["", None], "STRING"),
    "int_with_blank": (["5", "", None], "INT"),
    "late_text": (["1", "2", "x"], "STRING"),
    "newline": (["1\n"], "STRING"),
}


def _types(df):
    return {r["column"]: r["type"] for r in infer_column_types(df).collect()}


@pytest.mark.parametrize("name", CELLS)
def test_type_of_all_cells(spark, name):
    cells, expected = CELLS[name]
    df = spark.createDataFrame([(c,) for c in cells], f"{name} string").repartition(3)
    assert _types(df) == {name: expected}


def test_all_rows_decide(spark):
    df = spark.createDataFrame([("1", ""), ("x", "2")], "a string, b string").coalesce(1)
    assert _types(df) == {"a": "STRING", "b": "INT"}


@pytest.mark.parametrize(
    ("cells", "expected"),
    [
        (["123456789012345", "1.5"], "DOUBLE"),
        (["1234567890123456", "1.5"], "STRING"),  # a DOUBLE would round it
        (["1234567890123456", "1"], "BIGINT"),
        (["1", "1."], "STRING"),
        (["-", "1"], "STRING"),
        (["1-", "1"], "STRING"),
        (["-1.25", "-7"], "DOUBLE"),
    ],
)
def test_types_that_keep_every_value(spark, cells, expected):
    assert _types(spark.createDataFrame([(c,) for c in cells], "a string")) == {"a": expected}


def test_no_rows(spark):
    assert _types(spark.createDataFrame([], "a string")) == {"a": "STRING"}


def test_odd_column_names(spark):
    df = spark.createDataFrame([("1", "x")], ["a.b", "顧客 `x`".replace("`", "'")])
    assert list(_types(df).values()) == ["INT", "STRING"]


def test_crawl_of_the_sample_files(spark, tmp_path):
    source = tmp_path / "in"
    fixtures.write_csv(source / "input_ap.csv", fixtures.AP_HEADER, fixtures.AP_ROWS)
    fixtures.write_csv(
        source / "input_connection.csv", fixtures.CONNECTION_HEADER, fixtures.CONNECTION_ROWS
    )
    fixtures.write_csv(source / "master_status.csv", fixtures.STATUS_HEADER, fixtures.STATUS_ROWS)
    (source / "notes.txt").write_text("not a table")

    tables = crawl_directory(
        spark, str(source), "crawled", str(tmp_path / "out"), mappings=str(tmp_path / "maps")
    )
    assert [t.name for t in tables] == ["input_ap", "input_connection", "master_status"]
    points, connections, status = tables
    assert {c for c, t in points.types.items() if t == "DOUBLE"} == {"latitude", "longitude"}
    assert {c for c, t in points.types.items() if t == "INT"} == {"yearmonth"}
    assert connections.types == {
        "apid": "STRING", "start_time": "STRING", "user_attr": "STRING", "device_attr": "STRING",
        "provider": "STRING", "yearmonth": "INT",
    }
    assert status.types == {"column_0858": "STRING", "column_c286": "STRING"}

    read = spark.table("crawled.input_ap").orderBy("apid").collect()
    assert [r["latitude"] for r in read] == [36.238654, 34.350702, 39.648193]
    assert spark.table("crawled.input_connection").filter("apid is null").count() == 1

    mapping = spark.read.option("header", True).csv(str(tmp_path / "maps" / "master_status_mapping.csv"))
    assert {tuple(r) for r in mapping.collect()} == {
        ("column_0858", "各社ステータス"), ("column_c286", "共通ログステータス"),
    }
    assert mapping.columns == ["英語カラム名", "元のカラム名"]
    script = ddl_script(tables, "crawled")
    assert script.count("CREATE TABLE IF NOT EXISTS `crawled`.") == 3

    again = crawl_directory(
        spark, str(source), "crawled", str(tmp_path / "out"), ddl=str(tmp_path / "tables.sql")
    )
    assert [t.types for t in again] == [t.types for t in tables]
    assert (tmp_path / "tables.sql").read_text() == ddl_script(again, "crawled")
    assert spark.table("crawled.input_ap").count() == 3
    assert len(list((tmp_path / "out" / "input_ap").iterdir())) == 1


def test_crawl_does_not_misread_other_columns(spark, tmp_path):
    """A table keeps its columns and rows until a crawl may replace them."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    fixtures.write_csv(source / "moved.csv", ["a", "b"], [["1", "x"], ["2", "y"]])
    crawl_directory(spark, str(source), "moving", out)
    fixtures.write_csv(source / "moved.csv", ["b", "a", "c"], [["x", "1", "z"]])
    with pytest.raises(ContractError, match="other columns"):
        crawl_directory(spark, str(source), "moving", out)
    assert sorted(map(tuple, spark.table("moving.moved").collect())) == [(1, "x"), (2, "y")]
    crawl_directory(spark, str(source), "moving", out, replace=True)
    assert [r.asDict() for r in spark.table("moving.moved").collect()] == [{"b": "x", "a": 1, "c": "z"}]


def test_crawl_of_line_breaks(spark, tmp_path):
    source = tmp_path / "in"
    texts = ['two\nlines, "quoted"', "back\\slash", " blanks ", '"']
    fixtures.write_csv(source / "lines.csv", ["n", "t"], [[str(i), t] for i, t in enumerate(texts)])
    crawl_directory(spark, str(source), "broken", str(tmp_path / "out"), multi_line=True)
    assert [r["t"] for r in spark.table("broken.lines").orderBy("n").collect()] == texts


def test_landed_texts_are_as_they_were(spark, tmp_path):
    texts = ["plain", 'a"b', "a,b", "a\\b", "a,\\", " padded ", "it's"]
    source = tmp_path / "in"
    source.mkdir()
    fixtures.write_csv(source / "odd.csv", ["n", "t"], [[str(i), t] for i, t in enumerate(texts)])
    crawl_directory(spark, str(source), "odd_texts", str(tmp_path / "it's here"))
    rows = spark.table("odd_texts.odd").orderBy("n").collect()
    assert [r["t"] for r in rows] == texts
