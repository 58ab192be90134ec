import uuid

import pytest
from pyspark.sql import functions as F

from tsukiori.operators import aggregate, geocode
from tsukiori.operators.lookup import BroadcastLimit

SCHEMA = "id int, prefecture string, city string, address string, latitude double, longitude double"
ROWS = [
    (1, "P", "C", "A", 1.0, 2.0),
    (2, "P", "C", "A", None, 2.0),
    (3, "P", "C", "A", 1.0, None),
    (4, "P", "C", "A", None, None),
    (5, "P", "C", "unknown", None, 9.0),
    (6, "P", None, "A", None, 9.0),
    (7, "P", "C", "", 9.0, None),
    (8, "P", None, None, 3.0, 4.0),
    (9, "PC", "", "A", None, None),
    (10, "P", "C", "half", None, None),
]
FOUND = {
    1: (1.0, 2.0), 2: (10.0, 20.0), 3: (10.0, 20.0), 4: (10.0, 20.0), 5: (None, None),
    6: (None, None), 7: (None, None), 8: (3.0, 4.0), 9: (None, None), 10: (None, None),
}


@pytest.fixture
def gazetteer(spark):
    return spark.createDataFrame(
        [("P", "C", "A", 11.0, 5.0), ("P", "C", "A", 10.0, 20.0), ("P", "C", "half", 1.0, None),
         ("P", "C", "", 7.0, 7.0)],
        "prefecture string, city string, address string, latitude double, longitude double",
    )


@pytest.mark.parametrize("limit", [BroadcastLimit(), BroadcastLimit(rows=0)])
def test_both_or_none_are_replaced(spark, gazetteer, limit):
    df = spark.createDataFrame(ROWS, SCHEMA)
    result = geocode.geocode_missing(df, gazetteer, limit=limit)
    assert result.columns == df.columns
    assert {r["id"]: (r["latitude"], r["longitude"]) for r in result.collect()} == FOUND


def test_rank_decides_between_places(spark, gazetteer):
    ranked = gazetteer.selectExpr("*", "-latitude as rank")
    best = geocode.one_place_per_address(ranked, rank="rank").filter("address = 'A'").first()
    assert (best["latitude"], best["longitude"]) == (11.0, 5.0)


def test_unresolved_addresses_are_distinct_and_complete(spark, gazetteer):
    df = spark.createDataFrame(ROWS + ROWS, SCHEMA)
    unresolved = geocode.unresolved_addresses(df, gazetteer)
    assert sorted(r["address"] for r in unresolved.collect()) == ["half", "unknown"]


def test_resolver_fills_the_gazetteer(spark, gazetteer):
    df = spark.createDataFrame(ROWS, SCHEMA)
    unresolved = geocode.unresolved_addresses(df, gazetteer)

    def resolve(addresses):
        return addresses[addresses["address"] == "unknown"].assign(latitude=5.0, longitude=6.0)

    more = geocode.extend_gazetteer(gazetteer, unresolved, resolve, tasks=2)
    filled = geocode.geocode_missing(df, more).filter("id in (5, 10)").orderBy("id").collect()
    assert [(r["latitude"], r["longitude"]) for r in filled] == [(5.0, 6.0), (None, None)]


def test_a_service_is_asked_once_per_address(spark, gazetteer, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(i, "P", "C", f"new {i % 3}", None, None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)

    def resolve(addresses):
        for address in addresses["address"]:
            (calls / f"{address} {uuid.uuid4().hex}").touch()
        return addresses.assign(latitude=5.0, longitude=6.0)

    unresolved = geocode.unresolved_addresses(df, gazetteer)
    more = geocode.extend_gazetteer(gazetteer, unresolved, resolve, tasks=2)
    filled = geocode.geocode_missing(df, more)
    assert filled.filter("latitude = 5").count() == 30
    assert filled.filter("longitude = 6").count() == 30
    assert len(list(calls.iterdir())) == 3


def test_nan_is_missing(spark, gazetteer):
    df = spark.createDataFrame([(1, "P", "C", "A", float("nan"), 2.0), (2, "P", "C", "A", 3.0, float("nan"))], SCHEMA)
    rows = geocode.geocode_missing(df, gazetteer).collect()
    assert {(r["latitude"], r["longitude"]) for r in rows} == {(10.0, 20.0)}
    counts = aggregate.null_counts(df, ["latitude", "longitude", "address"]).first()
    assert tuple(counts) == (1, 1, 0)
    nowhere = gazetteer.withColumn("latitude", F.lit(float("nan")))
    assert geocode.geocode_missing(df, nowhere).filter("latitude is null and longitude is null").count() == 2


def test_the_gazetteer_is_grouped_once(spark, gazetteer):
    plan = geocode.geocode_missing(spark.createDataFrame(ROWS, SCHEMA), gazetteer)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
