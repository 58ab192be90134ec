import json
import re

import pytest

from tsukiori.errors import ContractError, EmptyDataError
from tsukiori.operators import quality


def test_contract_ignores_case_and_gives_agreed_names(spark):
    df = spark.createDataFrame([(1, 2)], ["APID", "x"])
    assert quality.check_contract(df, ["x", "apid"]).columns == ["x", "apid"]


@pytest.mark.parametrize("columns", [["apid", "y"], ["apid"], ["apid", "x", "y"]])
def test_contract_violations(spark, columns):
    with pytest.raises(ContractError):
        quality.check_contract(spark.createDataFrame([(1, 2)], ["apid", "x"]), columns)


def test_empty_frame_raises(spark):
    with pytest.raises(EmptyDataError, match="input"):
        quality.check_not_empty(spark.range(0), "input")


def _rows(spark):
    return spark.createDataFrame(
        [("a", 1.0), (None, 1.0), ("b", None), (None, None), ("c", float("nan"))],
        "k string, v double",
    )


def test_accepted_and_rejected_are_the_whole(spark):
    df = _rows(spark)
    good = quality.drop_null_required(df, ["k", "v"])
    bad = quality.select_rejects(df, ["k", "v"])
    assert [tuple(r) for r in good.collect()] == [("a", 1.0)]
    reasons = sorted(tuple(r[quality.REASONS]) for r in bad.collect())
    assert reasons == [("k",), ("k", "v"), ("v",), ("v",)]


def test_reject_report_keeps_the_row_with_its_nulls(spark):
    df = spark.createDataFrame(
        [(None, "2025-01-22 13:15:30", '引用"符', "202501")],
        "apid string, start_time string, provider string, yearmonth string",
    )
    rejects = quality.select_rejects(df, ["apid"])
    entry = quality.reject_report(rejects, "yearmonth", "job-7").first()
    assert json.loads(entry["row"]) == {
        "apid": None, "start_time": "2025-01-22 13:15:30", "provider": '引用"符',
        "yearmonth": "202501",
    }
    assert (entry["yearmonth"], entry["job_id"], entry["level"]) == ("202501", "job-7", "WARN")
    assert re.fullmatch(r"\d{4}/\d\d/\d\d \d\d:\d\d:\d\d", entry["logged_at"])


def test_log_time_is_that_of_tokyo(spark):
    from datetime import datetime, timedelta, timezone

    logged = spark.range(1).select(quality.log_time()).first()[0]
    tokyo = datetime.now(timezone(timedelta(hours=9))).replace(tzinfo=None)
    assert abs(datetime.strptime(logged, "%Y/%m/%d %H:%M:%S") - tokyo) < timedelta(minutes=2)
