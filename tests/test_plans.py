import re

import pytest

from tests import fixtures
from tsukiori import names, schemas
from tsukiori.errors import ContractError
from tsukiori.operators import quality
from tsukiori.operators.shape import relabel
from tsukiori.plans.access_points import access_point_list
from tsukiori.plans.connections import connection_log
from tsukiori.sources.readers import conform, rows_to_df


def _text(spark, header, rows, schema, known=names.ENGLISH_NAMES):
    df = spark.createDataFrame(
        [tuple(cell or None for cell in row) for row in rows], ", ".join(f"`{h}` string" for h in header)
    )
    return conform(df, schema, known)


@pytest.fixture
def points(spark):
    return _text(spark, fixtures.AP_HEADER, fixtures.AP_ROWS, schemas.ACCESS_POINT)


@pytest.fixture
def status(spark):
    return _text(spark, fixtures.STATUS_HEADER, fixtures.STATUS_ROWS, schemas.STATUS_MASTER,
                 names.STATUS_MASTER_NAMES)


@pytest.fixture
def gazetteer(spark):
    return rows_to_df(spark, [["長野県", "松本市", "丸の内4-1", 1.0, 2.0]], schemas.GAZETTEER)


@pytest.fixture
def connections(spark):
    return _text(spark, fixtures.CONNECTION_HEADER, fixtures.CONNECTION_ROWS, schemas.CONNECTION)


@pytest.fixture
def masters(spark):
    return (
        _text(spark, fixtures.USER_HEADER, fixtures.USER_ROWS, schemas.USER_MASTER,
              names.USER_MASTER_NAMES),
        _text(spark, fixtures.DEVICE_HEADER, fixtures.DEVICE_ROWS, schemas.DEVICE_MASTER,
              names.DEVICE_MASTER_NAMES),
    )


def _cells(df):
    return sorted(["" if v is None else str(v) for v in row] for row in df.collect())


def test_access_points_of_the_sample(points, status, gazetteer):
    checked = access_point_list(points, status, gazetteer, "202403")
    published = relabel(checked.accepted, names.ACCESS_POINT_HEADERS)
    assert published.columns == fixtures.AP_PUBLISHED_HEADER
    assert _cells(published) == sorted(fixtures.AP_PUBLISHED)
    assert dict(published.dtypes)["年月"] == "int"
    assert checked.rejected.isEmpty()


def test_access_point_without_coordinates(points, status, gazetteer):
    lost = points.selectExpr(
        *[c if c != "latitude" else "cast(null as double) latitude" for c in points.columns]
    )
    checked = access_point_list(lost, status, gazetteer, "202403")
    assert [(r["apid"], r["latitude"], r["longitude"]) for r in checked.accepted.collect()] == [
        ("02:4f:9a:10:c3:7e", 1.0, 2.0)
    ]
    rejected = checked.rejected.collect()
    assert len(rejected) == 2
    assert {tuple(r[quality.REASONS]) for r in rejected} == {("latitude", "longitude")}


def test_unknown_status_is_other_and_required_blank_is_rejected(points, status, gazetteer):
    odd = points.selectExpr(
        *[{"status": "'停止' status", "location": "'' location"}.get(c, c) for c in points.columns]
    )
    checked = access_point_list(odd, status, gazetteer, "202403")
    assert checked.accepted.isEmpty()
    rejected = checked.rejected.collect()
    assert {r["status"] for r in rejected} == {"その他"}
    assert {tuple(r[quality.REASONS]) for r in rejected} == {("location",)}


def test_access_points_of_a_month_without_rows(points, status, gazetteer):
    checked = access_point_list(points, status, gazetteer, "202404")
    assert checked.accepted.isEmpty() and checked.rejected.isEmpty()


def test_connections_of_the_sample(connections, masters):
    checked = connection_log(connections, *masters, "202403")
    published = relabel(checked.accepted, names.CONNECTION_HEADERS)
    assert published.columns == fixtures.CONNECTION_PUBLISHED_HEADER
    assert _cells(published) == sorted(fixtures.CONNECTION_PUBLISHED)
    (reject,) = checked.rejected.collect()
    assert reject["provider"] == "回線会社丁"


def test_connection_with_bad_time_and_unknown_codes(spark, masters):
    odd = _text(
        spark, fixtures.CONNECTION_HEADER,
        [["a", "2025/01/22", "xx", "IOS", "p", "202403"], ["b", "", "", "", "p", "202403"]],
        schemas.CONNECTION,
    )
    rows = connection_log(odd, *masters, "202403").accepted.collect()
    assert {(r["start_time"], r["user_attr"], r["device_attr"], r["year_month"], r["day"])
            for r in rows} == {(None, "その他", "その他", None, None)}


def test_connections_with_timestamps(spark, connections, masters):
    typed = connections.selectExpr(
        *[c if c != "start_time" else "timestamp(start_time) start_time" for c in connections.columns]
    )
    published = relabel(connection_log(typed, *masters, "202403").accepted, names.CONNECTION_HEADERS)
    assert _cells(published) == sorted(fixtures.CONNECTION_PUBLISHED)


def test_connections_with_surplus_column(connections, masters):
    with pytest.raises(ContractError):
        connection_log(connections.selectExpr("*", "1 extra"), *masters, "202403")


def test_connections_without_any_device_id(connections, masters):
    checked = connection_log(connections.filter("apid is null"), *masters, "202403")
    assert checked.accepted.isEmpty()
    assert checked.rejected.count() == 1


def _jobs_of(spark, build):
    """Spark jobs that a call runs before it returns."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        before = set(tracker.getJobIdsForGroup("counted"))
        build()
        return len(set(tracker.getJobIdsForGroup("counted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plans_measure_little_when_built(spark, points, status, gazetteer, connections, masters):
    assert _jobs_of(spark, lambda: connection_log(connections, *masters, "202403")) <= 5
    assert _jobs_of(spark, lambda: access_point_list(points, status, gazetteer, "202403")) <= 9


def test_month_without_connections_gives_no_rows(connections, masters):
    checked = connection_log(connections, *masters, "202404")
    assert checked.accepted.isEmpty()
    assert checked.rejected.count() == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_connection_plan_has_no_shuffle(spark, tmp_path, connections, masters):
    connections.write.partitionBy("yearmonth").parquet(str(tmp_path / "c"))
    table = spark.read.schema(schemas.CONNECTION).parquet(str(tmp_path / "c"))
    checked = connection_log(table, *masters, "202403")
    plan = _plan(checked.accepted)
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastHashJoin") == 2
    assert "Python" not in plan
    assert "PushedFilters: [IsNotNull(apid)]" in plan
    assert "(yearmonth#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNull(apid)]" in _plan(checked.rejected)


def test_access_point_plan_has_no_shuffle(spark, tmp_path, points, status, gazetteer):
    points.write.partitionBy("yearmonth").parquet(str(tmp_path / "a"))
    table = spark.read.schema(schemas.ACCESS_POINT).parquet(str(tmp_path / "a"))
    plan = _plan(access_point_list(table, status, gazetteer, "202403").accepted)
    assert "Exchange hashpartitioning" not in plan
    assert plan.count("BroadcastHashJoin") == 2
    assert "Python" not in plan
    assert "IsNotNull(ap_name)" in plan or "isnotnull(ap_name" in plan


def _largest_method(spark, df):
    """Bytes of the largest generated method; the JVM does not compile those above 8000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copy = df.select("*")
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(
            copy._jdf.queryExecution().executedPlan()
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_generated_code_is_small_enough_to_be_compiled(
    spark, tmp_path, points, status, gazetteer, connections, masters
):
    points.write.partitionBy("yearmonth").parquet(str(tmp_path / "a"))
    connections.write.partitionBy("yearmonth").parquet(str(tmp_path / "c"))
    table = spark.read.schema(schemas.ACCESS_POINT).parquet(str(tmp_path / "a"))
    log = spark.read.schema(schemas.CONNECTION).parquet(str(tmp_path / "c"))
    for checked in (
        access_point_list(table, status, gazetteer, "202403"),
        connection_log(log, *masters, "202403"),
    ):
        assert _largest_method(spark, checked.accepted) < 8000
        assert _largest_method(spark, checked.rejected) < 8000
