import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tsukiori import schemas
from tsukiori.errors import NameCollisionError
from tsukiori.functions.identifiers import management_id
from tsukiori.functions.metadata import expand_metadata
from tsukiori.functions.naming import (
    english_name,
    english_name_of,
    name_mapping,
    translate_columns,
)
from tsukiori.plans.recordings import recording_summary


@pytest.mark.parametrize("apid, expected", [
    ("00:11:22:33:44:55", "001122334455"),
    ("AA-BB-CC-DD-EE-FF", "AABBCCDDEEFF"),
    ("aa:bb-cc:dd-ee:ff", "aabbccddeeff"),
    ("ABCDEF123456", "ABCDEF123456"),
    ("xx00:11:22:33:44:55yy-z", "xx001122334455yyz"),
    ("00:11:22:33:44", "00:11:22:33:44"),
    ("gg:11:22:33:44:55", "gg:11:22:33:44:55"),
    ("", ""),
    (None, None),
])
def test_management_id(spark, apid, expected):
    df = spark.createDataFrame([(apid,)], "apid string")
    assert df.select(management_id(F.col("apid"))).first()[0] == expected


def test_management_id_of_any_text(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("0aF:-x", weights=[4, 4, 4, 3, 3, 1], k=rnd.randint(0, 30)))
             for _ in range(3000)]
    texts += [rnd.choice(["", "x-"]) + rnd.choice(":-").join(rnd.choices(["0a", "FF", "9"], k=6))
              for _ in range(500)]
    mac = re.compile("(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}")
    df = spark.createDataFrame([(t,) for t in texts], "apid string")
    for apid, mgmt in df.select("apid", management_id(F.col("apid"))).collect():
        assert mgmt == (re.sub("[:-]", "", apid) if mac.search(apid) else apid)


# Headers and the names a crawl gives them.
NAMED = {
    "ap名称": "ap_name",
    "利用開始日時": "start_time",
    "yearmonth": "yearmonth",
    "Video Id-2": "video_id_2",
    "各社ステータス": "column_0858",
    "共通ログステータス": "column_c286",
    "各社利用者属性": "column_a943",
    "共通ログ利用者属性": "column_c93e",
    "日本語表記": "column_fb57",
    "各社端末属性": "column_1650",
    "共通ログ端末属性": "column_1a29",
    "﻿video_id": "video_id",
}


def test_english_names():
    assert {header: english_name(header) for header in NAMED} == NAMED


def test_english_names_as_expression(spark):
    df = spark.createDataFrame(list(NAMED.items()), "header string, expected string")
    wrong = df.filter(english_name_of(F.col("header")) != F.col("expected"))
    assert wrong.collect() == []


def test_name_collision():
    with pytest.raises(NameCollisionError):
        name_mapping(["a b", "a-b"])


def test_translate_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["緯度", "Long Name"])
    assert translate_columns(df).columns == ["latitude", "long_name"]


def _recordings(spark):
    def row(video, model, driver, scenario, seconds):
        metadata = json.dumps({"model": model, "driver_id": driver, "scenario": scenario})
        return (video, "VIN", metadata, seconds, None, None, None, None, None, None)

    return spark.createDataFrame(
        [row("VID20250301001", "TestCar A", "D001", "city_driving", 300.5),
         row("VID20250301002", "TestCar B", "D002", "highway", 180.2)],
        schemas.RECORDING,
    )


def test_recording_summary(spark):
    summary = recording_summary(_recordings(spark))
    assert summary.expanded.columns == [
        "video_id", "vin", "model", "driver_id", "scenario", "recording_duration",
    ]
    durations = {r["scenario"]: r["total_duration"] for r in summary.duration_by_scenario.collect()}
    assert durations == {"city_driving": 300.5, "highway": 180.2}
    counts = {r["model"]: r["count"] for r in summary.count_by_model.collect()}
    assert counts == {"TestCar A": 1, "TestCar B": 1}


def test_bad_metadata_gives_nulls(spark):
    df = spark.createDataFrame(
        [("a", "v", "not json", 1.0), ("b", "v", None, 1.0), ("c", "v", '{"model": "M"}', 1.0)],
        "video_id string, vin string, metadata string, recording_duration double",
    )
    rows = {r["video_id"]: (r["model"], r["driver_id"]) for r in expand_metadata(df).collect()}
    assert rows == {"a": (None, None), "b": (None, None), "c": ("M", None)}
