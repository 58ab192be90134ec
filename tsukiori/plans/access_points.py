"""Monthly list of access points."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.functions.dates import to_iso8601
from tsukiori.functions.identifiers import management_id
from tsukiori.operators import quality
from tsukiori.operators.geocode import geocode_missing
from tsukiori.operators.lookup import DEFAULT_LIMIT, BroadcastLimit, unify_status
from tsukiori.operators.shape import blank_to_null, filter_month, select_columns
from tsukiori.plans.results import Checked

COORDINATES = ("latitude", "longitude")


def _converted(access_points, status_master, gazetteer, month, limit) -> DataFrame:
    rows = geocode_missing(filter_month(access_points, month), gazetteer, limit=limit)
    rows = unify_status(rows, status_master, limit=limit)
    rows = rows.withColumns(
        {
            "start_time": to_iso8601(F.col("start_time")),
            "end_time": to_iso8601(F.col("end_time")),
            "mgmt_id": management_id(F.col("apid")),
            "year_month": F.col(names.PARTITION_COLUMN).try_cast("int"),
        }
    )
    return select_columns(rows, list(names.ACCESS_POINT_HEADERS))


def access_point_rows(
    access_points: DataFrame,
    status_master: DataFrame,
    gazetteer: DataFrame,
    month: str,
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> DataFrame:
    """Every row of the month in its published form, good or bad.

    With lookups of broadcast size this is one pass over the month: no shuffle
    and no Python.
    """
    return blank_to_null(_converted(access_points, status_master, gazetteer, month, limit))


def access_point_list(
    access_points: DataFrame,
    status_master: DataFrame,
    gazetteer: DataFrame,
    month: str,
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> Checked:
    """The access-point list of a month, and the rows that lack a required value."""
    rows = _converted(access_points, status_master, gazetteer, month, limit)
    required = names.ACCESS_POINT_REQUIRED
    # Blank required values are filtered before blanks become null elsewhere: the
    # filters then reach the scan, and each is a plain comparison.
    filled = rows.filter(reduce(and_, [F.col(c) != "" for c in required if c not in COORDINATES]))
    optional = [c for c in rows.columns if c not in required]
    return Checked(
        blank_to_null(quality.drop_null_required(filled, COORDINATES), optional),
        quality.select_rejects(blank_to_null(rows), required),
    )
