import pytest
from pyspark.sql import functions as F

from tsukiori.errors import MonthError, NameCollisionError
from tsukiori.operators import aggregate, shape


def test_filter_month_needs_six_digits(spark):
    with pytest.raises(MonthError):
        shape.filter_month(spark.createDataFrame([("202501",)], ["yearmonth"]), "2025-01")


def test_apply_mapping_renames_casts_and_keeps(spark):
    df = spark.createDataFrame([("1", "x", "202501"), ("bad", "y", "n/a")], ["a", "b", "年月"])
    mapped = shape.apply_mapping(
        df, [("A", "string", "n", "int"), ("年月", "string", "年月", "int"),
             ("absent", "string", "z", "string")],
    )
    assert mapped.dtypes == [("n", "int"), ("b", "string"), ("年月", "int")]
    assert sorted(map(tuple, mapped.collect()), key=repr) == [(1, "x", 202501), (None, "y", None)]


def test_apply_mapping_swaps_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    swapped = shape.apply_mapping(df, [("a", "long", "b", "long"), ("b", "long", "a", "long")])
    assert swapped.first().asDict() == {"a": 2, "b": 1}


def test_apply_mapping_can_drop_unlisted(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert shape.apply_mapping(df, [("a", "long", "c", "long")], keep_unlisted=False).columns == ["c"]


def test_blank_to_null_leaves_other_types(spark):
    df = spark.createDataFrame([("", 0, 0.0), (" ", 1, 1.0)], "s string, i int, d double")
    assert sorted(map(tuple, shape.blank_to_null(df).collect()), key=repr) == [
        (" ", 1, 1.0), (None, 0, 0.0),
    ]


def test_sql_transform_with_regex_braces_and_lazy_result(spark):
    df = spark.createDataFrame([("00:11",), ("zz",)], ["apid"])
    result = shape.sql_transform(
        spark, "select count(*) n from ap where apid rlike '[0-9]{2}:[0-9]{2}'", {"ap": df}
    )
    assert not spark.catalog.tableExists("ap")
    assert result.first()["n"] == 1


def test_sql_transform_puts_a_shadowed_view_back(spark):
    spark.range(3).createOrReplaceTempView("shadowed")
    try:
        inner = shape.sql_transform(
            spark, "select count(*) n from shadowed", {"shadowed": spark.range(5)}
        )
        assert inner.first()["n"] == 5
        assert spark.table("shadowed").count() == 3
    finally:
        spark.catalog.dropTempView("shadowed")


def test_retain_latest_has_all_rows_of_the_months(spark):
    df = spark.createDataFrame(
        [("202411", 1), ("202412", 2), ("202501", 3), ("202501", 3), (None, 4)],
        "yearmonth string, v int",
    )
    assert sorted(r["v"] for r in aggregate.retain_latest(df, 2).collect()) == [2, 3, 3]


def test_null_counts_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert aggregate.null_counts(df, ["a", "b"]).first().asDict() == {"a": 0, "b": 0}


def test_sum_by_skips_null_values_and_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "k string, v double")
    sums = {r["k"]: r["t"] for r in aggregate.sum_by(df, "k", "v", "t").collect()}
    assert sums == {"a": 1.0, None: 2.0}


def test_relabel_orders_and_renames(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("c"))
    assert shape.relabel(df, {"b": "乙", "a": "甲"}).columns == ["乙", "甲"]


@pytest.mark.parametrize(
    "mappings",
    [
        [("a", "string", "b", "string")],  # beside the unlisted b
        [("a", "string", "x", "string"), ("A", "string", "y", "string")],
        [("a", "string", "x", "string"), ("b", "string", "X", "string")],
    ],
)
def test_mappings_may_not_hide_columns(spark, mappings):
    with pytest.raises(NameCollisionError):
        shape.apply_mapping(spark.createDataFrame([("1", "2")], "a string, b string"), mappings)
