import pytest
from pyspark.sql import functions as F

from tsukiori.errors import DuplicateKeyError
from tsukiori.operators import lookup
from tsukiori.operators.lookup import BroadcastLimit, left_lookup, lookup_code, profile

NOTHING = BroadcastLimit(rows=0, bytes=0)


def _facts(spark, n=3000):
    """A third of the rows share a key, a tenth have none, some keys are unknown."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("id"),
        F.when(i % 3 == 0, "hot").when(i % 10 == 1, None)
        .otherwise(F.concat(F.lit("k"), (i % 97).cast("string"))).alias("code"),
        (i % 2 == 0).alias("wanted"),
    )


def _master(spark, n=80):
    codes = spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("code"))
    codes = codes.union(spark.createDataFrame([("hot",), (None,), ("never",)], "code string"))
    return codes.withColumn("name", F.concat(F.lit("name of "), F.coalesce("code", F.lit("null"))))


def _plain(df, master, wanted_only=False):
    names = {r["code"]: r["name"] for r in master.collect() if r["code"] is not None}
    return sorted(
        (r["id"], r["code"], names.get(r["code"]) if r["wanted"] or not wanted_only else None)
        for r in df.collect()
    )


def _result(joined):
    return sorted((r["id"], r["code"], r["name"]) for r in joined.collect())


# The facts have 98 distinct keys, the master 202 rows with a key.
LIMITS = {
    "broadcast": BroadcastLimit(),
    "reduced": BroadcastLimit(rows=98),
    "shuffled or split": NOTHING,
}


@pytest.fixture(params=[1, 2, 8])
def tasks(request, spark):
    """Shuffle partitions; with more of them, a key is hot sooner."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("plan", LIMITS)
@pytest.mark.parametrize("wanted_only", [False, True])
def test_all_plans_agree(spark, tasks, plan, wanted_only):
    facts, master = _facts(spark), _master(spark, 200)
    needed = F.col("wanted") if wanted_only else None
    joined = left_lookup(facts, master, ["code"], needed=needed, limit=LIMITS[plan])
    assert joined.columns == ["id", "code", "wanted", "name"]
    assert _result(joined) == _plain(facts, master, wanted_only)


def _executed(spark, frame_of):
    """Physical plan without Spark's own broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame_of()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plan_by_size_and_frequency(spark, tmp_path):
    _facts(spark).write.parquet(str(tmp_path / "facts"))
    facts, master = spark.read.parquet(str(tmp_path / "facts")), _master(spark, 200)

    def plan(limit, rows=facts):
        return _executed(spark, lambda: left_lookup(rows, master, ["code"], limit=limit))

    assert "SortMergeJoin" not in plan(LIMITS["broadcast"])
    assert "SortMergeJoin" not in plan(LIMITS["reduced"])
    even = plan(NOTHING, facts.filter("code <> 'hot'"))
    assert (even.count("SortMergeJoin"), even.count("BroadcastHashJoin")) == (1, 0)
    split = plan(NOTHING)
    assert split.count("SortMergeJoin") == 1
    for text in (even, split):  # the keys were counted before, this is one read more
        assert text.count(f"{tmp_path}/facts") == 1


@pytest.mark.parametrize("duplicates", [1, 5])
def test_hot_rows_are_dealt_to_several_tasks(spark, duplicates):
    """A third of the rows share a key and some have none, yet no task makes many rows."""
    off = {"autoBroadcastJoinThreshold": "-1", "adaptive.enabled": "false"}
    for setting, value in off.items():
        spark.conf.set(f"spark.sql.{setting}", value)
    try:
        master = _master(spark, 200).crossJoin(spark.range(duplicates).select("id")).drop("id")
        joined = left_lookup(_facts(spark, 6000), master, ["code"], limit=NOTHING, allow_duplicates=duplicates > 1)
        by_task = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for setting in off:
            spark.conf.unset(f"spark.sql.{setting}")
    assert len(by_task) == 8
    assert max(by_task) < 2 * sum(by_task) / 8


@pytest.mark.parametrize("limit", [BroadcastLimit(), NOTHING])
def test_duplicate_key_raises_or_multiplies(spark, limit):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, code string")
    master = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "code string, name string")
    with pytest.raises(DuplicateKeyError):
        left_lookup(facts, master, ["code"], limit=limit)
    joined = left_lookup(facts, master, ["code"], allow_duplicates=True, limit=limit)
    assert sorted(map(tuple, joined.collect())) == [
        (1, "a", "x"), (1, "a", "y"), (2, "b", "z"), (3, None, None),
    ]


def test_repeated_null_keys_are_no_duplicates(spark):
    master = spark.createDataFrame([(None, "x"), (None, "y"), ("a", "z")], "code string, name string")
    assert profile(master, ["code"]).max_per_key == 1


def test_profile_measures_rows_and_bytes(spark):
    master = spark.createDataFrame([("ab", "xyz"), ("c", None)], "code string, name string")
    measured = profile(master, ["code"])
    assert measured.rows == 2
    assert measured.bytes == 2 + 3 + 1 + 4 * 16
    assert measured.widest == 2 + 3 + 2 * 16
    assert measured.fits(BroadcastLimit(rows=2, bytes=70))
    assert not measured.fits(BroadcastLimit(rows=1, bytes=70))
    assert not measured.fits(BroadcastLimit(rows=2, bytes=69))


def test_profile_of_an_empty_lookup(spark):
    assert profile(spark.createDataFrame([], "code string"), ["code"]) == lookup.Profile(0, 0, 0, 0)


def test_lookup_code_labels_what_is_unknown(spark):
    df = spark.createDataFrame(
        [(1, "macOS", "p"), (2, "MACOS", "p"), (3, None, "p"), (4, "nul", "p")],
        "id int, device_attr string, provider string",
    )
    master = spark.createDataFrame(
        [("macOS", "macos"), ("nul", None)], "operator_device_attr string, common_device_attr string"
    )
    result = lookup.unify_device_attr(df, master)
    assert result.columns == df.columns
    assert [tuple(r) for r in result.orderBy("id").collect()] == [
        (1, "macos", "p"), (2, "その他", "p"), (3, "その他", "p"), (4, "その他", "p"),
    ]


def test_lookup_code_with_own_default(spark):
    df = spark.createDataFrame([("q",)], "c string")
    master = spark.createDataFrame([("a", "b")], "k string, v string")
    assert lookup_code(df, "c", master, "k", "v", default="?").first()["c"] == "?"


def test_value_columns_may_not_hide_columns(spark):
    df = spark.createDataFrame([("a", "x")], "code string, name string")
    with pytest.raises(ValueError, match="name"):
        left_lookup(df, df, ["code"])
