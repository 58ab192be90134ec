"""Whole runs from files to published files."""

import csv
import json
import logging
import uuid

import pytest
from pyspark.sql import functions as F

from tests import fixtures
from tsukiori import jobs, names, schemas, scratch
from tsukiori.errors import EmptyDataError, MonthError
from tsukiori.sinks import files
from tsukiori.sources.readers import read_csv_table


@pytest.fixture
def inputs(tmp_path):
    folder = tmp_path / "in"
    return {
        "points": fixtures.write_csv(folder / "ap.csv", fixtures.AP_HEADER, fixtures.AP_ROWS),
        "status": fixtures.write_csv(
            folder / "status.csv", fixtures.STATUS_HEADER, fixtures.STATUS_ROWS, quoted=False
        ),
        "connections": fixtures.write_csv(
            folder / "connection.csv", fixtures.CONNECTION_HEADER, fixtures.CONNECTION_ROWS
        ),
        "users": fixtures.write_csv(
            folder / "user.csv", fixtures.USER_HEADER, fixtures.USER_ROWS, quoted=False
        ),
        "devices": fixtures.write_csv(
            folder / "device.csv", fixtures.DEVICE_HEADER, fixtures.DEVICE_ROWS, quoted=False
        ),
    }


def _csv(path):
    with open(path, encoding="utf-8", newline="") as f:
        header, *rows = csv.reader(f)
    return header, sorted(rows)


def _points(inputs, out, month="202403", *more):
    jobs.main(["access-points", "--input", inputs["points"], "--status-master", inputs["status"],
               "--output", str(out), "--month", month, "--single-file", *more])


def _connections(inputs, out, *more, month="202403"):
    jobs.main(["connections", "--user-master", inputs["users"], "--device-master",
               inputs["devices"], "--output", str(out), "--month", month, "--single-file", *more])


def test_access_points_end_to_end(spark, inputs, tmp_path):
    out = tmp_path / "out"
    _points(inputs, out)
    expected = (fixtures.AP_PUBLISHED_HEADER, sorted(fixtures.AP_PUBLISHED))
    assert _csv(out / "list_ap_table" / "listap202403.csv") == expected
    assert _csv(out / "list_ap_backup" / "backup_listap202403.csv") == expected
    common = spark.read.parquet(str(out / "common_ap"))
    assert common.columns == [*fixtures.AP_PUBLISHED_HEADER, "yearmonth"]
    assert common.count() == 3
    rejects = spark.read.parquet(str(out / "rejects"))
    assert rejects.count() == 0


def test_rejects_are_written_and_counted(spark, inputs, tmp_path, caplog):
    rows = [[*r] for r in fixtures.AP_ROWS]
    rows[0][7] = ""
    rows[1][2] = ""
    inputs["points"] = fixtures.write_csv(tmp_path / "in" / "ap2.csv", fixtures.AP_HEADER, rows)
    out = tmp_path / "out"
    with caplog.at_level(logging.WARNING):
        _points(inputs, out, "202403", "--job-id", "j1")
    assert "2 rows rejected" in caplog.text
    rejects = spark.read.parquet(str(out / "rejects")).collect()
    assert {tuple(r["reject_reasons"]) for r in rejects} == {
        ("latitude", "longitude"), ("location",),
    }
    assert {r["job_id"] for r in rejects} == {"j1"}
    assert len(_csv(out / "list_ap_table" / "listap202403.csv")[1]) == 1

    inputs["points"] = fixtures.write_csv(
        tmp_path / "in" / "ap3.csv", fixtures.AP_HEADER, fixtures.AP_ROWS
    )
    _points(inputs, out)
    assert spark.read.parquet(str(out / "rejects")).count() == 0


def test_gazetteer_argument(spark, inputs, tmp_path):
    rows = [[*r] for r in fixtures.AP_ROWS]
    rows[0][7] = ""
    inputs["points"] = fixtures.write_csv(tmp_path / "in" / "ap4.csv", fixtures.AP_HEADER, rows)
    gazetteer = str(tmp_path / "gazetteer")
    spark.createDataFrame(
        [("長野県", "松本市", "丸の内4-1", 35.0, 139.0)], schemas.GAZETTEER
    ).write.parquet(gazetteer)
    _points(inputs, tmp_path / "out", "202403", "--gazetteer", gazetteer)
    _, published = _csv(tmp_path / "out" / "list_ap_table" / "listap202403.csv")
    assert [r[8:10] for r in published if r[0] == "024f9a10c37e"] == [["35.0", "139.0"]]


def test_a_bad_month_leaves_published_data_alone(spark, inputs, tmp_path):
    out = tmp_path / "out"
    _points(inputs, out)
    bad = [[*r] for r in fixtures.AP_ROWS]
    for row in bad:
        row[2] = ""
    inputs["points"] = fixtures.write_csv(tmp_path / "in" / "bad.csv", fixtures.AP_HEADER, bad)
    with pytest.raises(EmptyDataError):
        _points(inputs, out, "202403", "--replace-all")
    assert len(_csv(out / "list_ap_table" / "listap202403.csv")[1]) == 3
    assert spark.read.parquet(str(out / "common_ap")).count() == 3


def test_staged_rows_are_removed(spark, inputs, tmp_path):
    scratch = spark.conf.get("spark.checkpoint.dir")
    before = files.list_names(spark, scratch)
    _points(inputs, tmp_path / "out")
    assert files.list_names(spark, scratch) == before


def test_connections_as_csv(spark, inputs, tmp_path):
    out = tmp_path / "log"
    _connections(inputs, out, "--input", inputs["connections"], "--format", "csv")
    assert _csv(out / "yearmonth=202403" / "connection_data.csv") == (
        fixtures.CONNECTION_PUBLISHED_HEADER, sorted(fixtures.CONNECTION_PUBLISHED)
    )
    (reject,) = spark.read.parquet(str(tmp_path / "log_rejects" / "rejects")).collect()
    assert "回線会社丁" in reject["row"]


def test_connections_from_and_to_parquet(spark, inputs, tmp_path):
    spark.createDataFrame(
        [tuple(c or None for c in r) for r in fixtures.CONNECTION_ROWS]
        + [("x", "2025-02-01 00:00:00", "ja", "ios", "p", "202404")],
        ", ".join(f"`{h}` string" for h in fixtures.CONNECTION_HEADER),
    ).write.partitionBy("yearmonth").parquet(str(tmp_path / "table"))
    out = tmp_path / "log"
    for month in ("202403", "202404"):
        _connections(inputs, out, "--input-table", str(tmp_path / "table"), month=month)
    log = spark.read.parquet(str(out))
    assert log.columns == [*fixtures.CONNECTION_PUBLISHED_HEADER, "yearmonth"]
    assert sorted(r["yearmonth"] for r in log.collect()) == [202403] * 4 + [202404]
    assert all("snappy" in p.name for p in out.glob("*/part-*"))
    _connections(inputs, out, "--input-table", str(tmp_path / "table"), "--replace-all")
    assert spark.read.parquet(str(out)).count() == 4


def test_empty_month_does_not_empty_the_log(spark, inputs, tmp_path):
    out = tmp_path / "log"
    _connections(inputs, out, "--input", inputs["connections"])
    with pytest.raises(EmptyDataError):
        _connections(
            inputs, out, "--input", inputs["connections"], "--replace-all", month="202404"
        )
    assert spark.read.parquet(str(out)).count() == 4


def test_crawl_command(spark, inputs, tmp_path):
    jobs.main(["crawl", "--input", str(tmp_path / "in"), "--database", "crawl_job",
               "--warehouse", str(tmp_path / "warehouse")])
    assert spark.table("crawl_job.connection").count() == 5


def test_access_points_from_the_catalog(spark, inputs, tmp_path):
    crawled = tmp_path / "crawled"
    fixtures.write_csv(crawled / "input_ap.csv", fixtures.AP_HEADER, fixtures.AP_ROWS)
    jobs.main(["crawl", "--input", str(crawled), "--database", "crawl_points",
               "--warehouse", str(tmp_path / "warehouse")])
    out = tmp_path / "out"
    jobs.main(["access-points", "--catalog-table", "crawl_points.input_ap", "--status-master",
               inputs["status"], "--output", str(out), "--month", "202403", "--single-file"])
    assert _csv(out / "list_ap_table" / "listap202403.csv") == (
        fixtures.AP_PUBLISHED_HEADER, sorted(fixtures.AP_PUBLISHED)
    )


def test_recordings_command(spark, tmp_path):
    path = tmp_path / "recordings.csv"
    header = [f.name for f in schemas.RECORDING.fields]
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL)
        out.writerow(header)
        for video, scenario, seconds in (("a", "highway", 180.2), ("b", "city_driving", 300.5)):
            metadata = json.dumps({"model": "M", "driver_id": "D", "scenario": scenario})
            out.writerow([video, "v", metadata, seconds, *[""] * 6])
    target = tmp_path / "summary"
    jobs.main(["recordings", "--input", str(tmp_path / "absent"), str(path), "--output", str(target)])

    def rows(name):
        return {tuple(r) for r in spark.read.option("header", True).csv(str(target / name)).collect()}

    assert rows("duration_by_scenario") == {("highway", "180.2"), ("city_driving", "300.5")}
    assert rows("count_by_model") == {("M", "2")}
    assert rows("expanded") == {
        ("a", "v", "M", "D", "highway", "180.2"), ("b", "v", "M", "D", "city_driving", "300.5"),
    }


def test_sql_command(spark, tmp_path, capsys):
    jobs.main(["sql", "--query", "select 42 as answer", "--output", str(tmp_path / "sql")])
    assert "42" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(str(tmp_path / "sql")).first()["answer"] == "42"


def test_quote_command(spark, tmp_path):
    rows = [["a", "b"], ['say "x"', "1,2"], ["two\nlines", "back\\slash"]]
    with open(tmp_path / "in.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows(rows)
    jobs.main(["quote-csv", "--input", str(tmp_path / "in.csv"), "--multi-line",
               "--output", str(tmp_path / "quoted")])
    (part,) = (tmp_path / "quoted").glob("part-*")
    with open(part, encoding="utf-8", newline="") as f:
        text = f.read()
    assert text.startswith('"a","b"')
    assert list(csv.reader(text.splitlines(keepends=True))) == rows


def test_month_is_required_and_checked(inputs, tmp_path):
    with pytest.raises(SystemExit):
        jobs.main(["access-points", "--input", "x", "--status-master", "y", "--output", "z"])
    with pytest.raises((SystemExit, MonthError)):
        _points(inputs, tmp_path, "2025-01")


def test_lists_are_directories_unless_asked_for_as_files(spark, inputs, tmp_path):
    out = tmp_path / "out"
    jobs.main(["access-points", "--input", inputs["points"], "--status-master", inputs["status"],
               "--output", str(out), "--month", "202403"])
    assert (out / "list_ap_table" / "listap202403.csv").is_dir()
    assert spark.read.option("header", True).csv(str(out / "list_ap_table" / "listap202403.csv")).count() == 3


def test_report_counts_what_is_missing(spark, inputs, tmp_path):
    points = read_csv_table(spark, inputs["points"], schemas.ACCESS_POINT)
    points = points.withColumn("latitude", F.when(F.col("apid") != "90e6ba12cd34", F.col("latitude")))
    status = read_csv_table(spark, inputs["status"], schemas.STATUS_MASTER, names.STATUS_MASTER_NAMES)
    places = spark.createDataFrame([], schemas.GAZETTEER)
    report = jobs.run_access_point_list(spark, points, status, places, str(tmp_path / "out"), "202403")
    assert (report.accepted, report.rejected) == (2, 1)
    assert {c for c, n in report.missing.items() if n} == {"latitude", "longitude"}


def test_a_run_resolves_unknown_addresses(spark, inputs, tmp_path):
    points = read_csv_table(spark, inputs["points"], schemas.ACCESS_POINT).withColumn("latitude", F.lit(None).cast("double"))
    status = read_csv_table(spark, inputs["status"], schemas.STATUS_MASTER, names.STATUS_MASTER_NAMES)
    known = spark.createDataFrame([("長野県", "松本市", "丸の内4-1", 1.0, 2.0)], schemas.GAZETTEER)
    calls = tmp_path / "calls"
    calls.mkdir()

    def resolve(addresses):
        for city in addresses["city"]:
            (calls / f"{city} {uuid.uuid4().hex}").touch()
        return addresses[addresses["city"] == "高松市"].assign(latitude=3.0, longitude=4.0)

    report = jobs.run_access_point_list(
        spark, points, status, known, str(tmp_path / "out"), "202403", resolve=resolve, resolve_tasks=2
    )
    assert (report.accepted, report.rejected) == (2, 1)
    assert sorted(p.name.split()[0] for p in calls.iterdir()) == ["盛岡市", "高松市"]


def _connection_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.CONNECTION)


def _run(spark, inputs, rows, out, month):
    users = read_csv_table(spark, inputs["users"], schemas.USER_MASTER, names.USER_MASTER_NAMES)
    devices = read_csv_table(spark, inputs["devices"], schemas.DEVICE_MASTER, names.DEVICE_MASTER_NAMES)
    return jobs.run_connection_log(spark, _connection_rows(spark, rows), users, devices, out, month)


def test_rejects_of_two_months_are_entered_once(spark, inputs, tmp_path):
    rows = [("a", "", "", "", "p", m) for m in ("202403", "202404")]
    rows += [(None, "", "", "", "p", m) for m in ("202403", "202404", "202404", None)]
    out = str(tmp_path / "log") + "/"
    for month in ("202403", "202404", "202404"):
        _run(spark, inputs, rows, out, month)
    entries = spark.read.parquet(str(tmp_path / "log_rejects" / "rejects")).collect()
    assert sorted(str(r["row_month"]) for r in entries) == ["202403", "202404", "202404", "None"]
    assert not (tmp_path / "log" / "_rejects").exists()


def test_rejects_are_written_before_a_run_fails(spark, inputs, tmp_path):
    with pytest.raises(EmptyDataError):
        _run(spark, inputs, [(None, "", "", "", "p", "202403")] * 2, str(tmp_path / "log"), "202403")
    assert spark.read.parquet(str(tmp_path / "log_rejects" / "rejects")).count() == 2
    with pytest.raises(EmptyDataError):  # a month without rows leaves earlier entries alone
        _run(spark, inputs, [], str(tmp_path / "log"), "202403")
    assert spark.read.parquet(str(tmp_path / "log_rejects" / "rejects")).count() == 2


def test_other_lists_go_with_replace_all(spark, inputs, tmp_path):
    out = tmp_path / "out"
    _points(inputs, out)
    (out / "list_ap_table" / "listap202312.csv").write_text("a\n1\n")
    _points(inputs, out, "202403", "--replace-all")
    assert [p.name for p in (out / "list_ap_table").glob("*.csv")] == ["listap202403.csv"]


def test_commands_take_a_dialect(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a;b\n'x\\'y';1\n")
    jobs.main(["quote-csv", "--input", str(tmp_path / "in.csv"), "--sep", ";", "--quote", "'", "--escape", "\\",
               "--output", str(tmp_path / "q")])
    (part,) = (tmp_path / "q").glob("part-*")
    assert part.read_text().splitlines() == ['"a","b"', '"x\'y","1"']


def test_scratch_folder_without_a_setting(spark, monkeypatch):
    setting = spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: {
        "spark.checkpoint.dir": None, "spark.sql.warehouse.dir": "file:/w/"}.get(key, setting))
    assert scratch.scratch_dir(spark) == "file:/w/_scratch"


def test_a_block_cleans_what_it_made(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = files.list_names(spark, folder)
    dropped = []
    with scratch.cleaned(spark):
        scratch.stage(spark.range(3), "one")
        scratch.at_clean(lambda: dropped.append(1))
        assert len(files.list_names(spark, folder)) == len(before) + 1
    assert files.list_names(spark, folder) == before and dropped == [1]
