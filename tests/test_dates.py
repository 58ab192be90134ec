import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import iso_by_strptime
from tsukiori.errors import MonthError
from tsukiori.functions.dates import (
    check_month,
    day_of_month,
    parse_start_time,
    to_iso8601,
    year_month_int,
)

def assert_like_strptime(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, iso in df.select("text", to_iso8601(F.col("text"))).collect():
        assert iso == iso_by_strptime(text), text


def test_iso_edge_cases(spark):
    assert_like_strptime(spark, [
        "2025/01/01", "2025/1/1", "2025-1-1 9:5", "2025/01/01 09:00", "2025-01-01 09:00:07",
        "2025/01/01   09:00", "2025/01/01\t09:00", "2025/01/01　09:00", "2025/01/ 5",
        "2025/01/ 5 9:00", "2025/01/  5", "2025/01/01 09:00:00.1", "2025/01/01 09:00:00.123456",
        "2025/01/01 09:00:00.000000", "2025/01/01 09:00:00.1234567", "2025/01/01 09:00:00.",
        "2025-02-30", "2024-02-29", "2025-02-29", "1900-02-29", "2000-02-29", "2025-04-31",
        "2025-01-01 24:00", "2025-01-01 23:60", "2025-01-01 23:59:60", "2025-01-01 23:59:61",
        "2025/01/01T09:00:00", "2025-01-01T09:00:00", "2025-01-01t09:00:00", "2025-01-01T09:00",
        "2025-01-01T09:00:00.5", "2025-01-01T09:00:00Z", "2025-01-01T09:00:00+09:00",
        "2025-01-01 09:00:00+0900", " 2025-01-01", "2025-01-01 ", "2025-01-01\n", "25-01-01",
        "0000-01-01", "0001-01-01", "12025-01-01", "2025-001-01", "2025/01-01", "2025-13-01",
        "2025-00-01", "2025-01-00", "2025-01-32", "", "x", "20250101",
    ])


def test_iso_of_null_is_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(to_iso8601(F.col("text"))).first()[0] is None


_FIELD = st.integers(0, 62).flatmap(lambda n: st.sampled_from([str(n), f"{n:02d}", f" {n}"]))


@settings(max_examples=3, deadline=None)
@given(st.lists(
    st.tuples(
        st.sampled_from(["2025", "2024", "0000", "999"]), st.sampled_from("/-"), _FIELD,
        st.sampled_from("/-"), _FIELD, st.sampled_from(["", " ", "  ", "T", "t", "　"]),
        st.lists(_FIELD, max_size=3), st.sampled_from(["", ".", ".5", ".000000", ".1234567"]),
    ),
    min_size=200, max_size=400,
))
def test_iso_like_strptime_on_any_fields(spark, samples):
    assert_like_strptime(spark, [
        y + s1 + m + s2 + d + gap + ":".join(clock) + fraction
        for y, s1, m, s2, d, gap, clock, fraction in samples
    ])


def test_iso_like_strptime_on_plausible_dates(spark):
    rnd = random.Random(7)

    def text():
        separator = rnd.choice("/-")
        day = separator.join([
            str(rnd.choice([1999, 2000, 2024, 2025])),
            rnd.choice(["%d", "%02d"]) % rnd.randint(1, 12),
            rnd.choice(["%d", "%02d", "%2d"]) % rnd.randint(1, 31),
        ])
        clock = "%d:%02d" % (rnd.randint(0, 23), rnd.randint(0, 59))
        seconds = rnd.choice(["", ":%02d" % rnd.randint(0, 59), ":07.%06d" % rnd.randint(0, 3)])
        return rnd.choice([day, day + rnd.choice([" ", "  ", "T"]) + clock + seconds])

    assert_like_strptime(spark, [text() for _ in range(5000)])


def test_iso_does_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([("2025-03-09 02:30:00",)], "text string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(to_iso8601(F.col("text"))).first()[0] == "2025-03-09T02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_start_time_parts(spark):
    df = spark.createDataFrame(
        [("2025-01-22 09:15:30",), ("2025/01/22 09:15:30",), ("2025-02-30 00:00:00",), ("",),
         (None,)],
        "text string",
    )
    start = parse_start_time(F.col("text"))
    rows = df.select(year_month_int(start), day_of_month(start)).collect()
    assert [tuple(r) for r in rows] == [(202501, 22)] + [(None, None)] * 4


@pytest.mark.parametrize("month", ["20251", "2025011", "2025-1", "", "abcdef", "202501\n"])
def test_malformed_month(month):
    with pytest.raises(MonthError):
        check_month(month)
