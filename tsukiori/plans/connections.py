"""Monthly log of connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori import names, schemas
from tsukiori.functions.dates import day_of_month, parse_start_time, year_month_int
from tsukiori.functions.identifiers import management_id
from tsukiori.operators import quality
from tsukiori.operators.lookup import (
    DEFAULT_LIMIT,
    BroadcastLimit,
    code_profiles,
    unify_device_attr,
    unify_user_attr,
)
from tsukiori.operators.shape import filter_month, select_columns
from tsukiori.plans.results import Checked


def with_start_date(df: DataFrame) -> DataFrame:
    """Start time as text, null if it does not parse, with its month and day."""
    start = F.col("start_time")
    if isinstance(df.schema["start_time"].dataType, T.StringType):
        moment = parse_start_time(start)
    else:
        moment = start
    return df.withColumns(
        {
            "start_time": F.when(moment.isNotNull(), start.cast("string")),
            "year_month": year_month_int(moment),
            "day": day_of_month(moment),
        }
    )


def connection_log(
    connections: DataFrame,
    user_master: DataFrame,
    device_master: DataFrame,
    month: str,
    limit: BroadcastLimit = DEFAULT_LIMIT,
) -> Checked:
    """The connection log of a month, and the rows of any month without a device id.

    Only the masters are measured when this is called.
    """
    columns = quality.check_contract(connections, schemas.CONNECTION.fieldNames())
    identified = quality.drop_null_required(columns, names.CONNECTION_REQUIRED)
    user, device = code_profiles(
        [(user_master, "operator_user_attr"), (device_master, "operator_device_attr")]
    )
    log = (
        filter_month(identified, month)
        .transform(unify_user_attr, user_master, limit=limit, measured=user)
        .transform(unify_device_attr, device_master, limit=limit, measured=device)
        .withColumn("mgmt_id", management_id(F.col("apid")))
        .transform(with_start_date)
        .transform(select_columns, list(names.CONNECTION_HEADERS))
    )
    return Checked(log, quality.select_rejects(columns, names.CONNECTION_REQUIRED))
