"""Declared schemas of the known inputs.

Nothing is inferred for these: an inferred date column would reach the date
normaliser as a timestamp, and an inferred month would be compared as a number.
"""

from __future__ import annotations

from pyspark.sql import types as T

from tsukiori import names


def _fields(columns, **typed):
    return T.StructType(
        [T.StructField(c, typed.get(c, T.StringType()), True) for c in columns]
    )


ACCESS_POINT = _fields(
    [
        "apid", "ap_name", "location", "prefecture", "city", "address",
        "additional_info", "latitude", "longitude", "status", "start_time",
        "end_time", "category", "owner_attr", "facility_attr", "station_attr",
        "provider", "yearmonth",
    ],
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
)

CONNECTION = _fields(
    ["apid", "start_time", "user_attr", "device_attr", "provider", "yearmonth"]
)

STATUS_MASTER = _fields(names.STATUS_MASTER_NAMES.values())
USER_MASTER = _fields(names.USER_MASTER_NAMES.values())
DEVICE_MASTER = _fields(names.DEVICE_MASTER_NAMES.values())

GAZETTEER = _fields(
    ["prefecture", "city", "address", "latitude", "longitude"],
    latitude=T.DoubleType(),
    longitude=T.DoubleType(),
)

RECORDING = _fields(
    [
        "video_id", "vin", "metadata", "recording_duration", "start_datetime",
        "end_datetime", "url", "thumbnail", "labels", "can_data",
    ],
    recording_duration=T.DoubleType(),
)

RECORDING_METADATA = _fields(["model", "driver_id", "scenario"])
