"""JSON held in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori import schemas


def parse_metadata(text: Column, schema: T.StructType = schemas.RECORDING_METADATA) -> Column:
    """Struct of the declared JSON fields; fields are null where the JSON is bad."""
    return F.from_json(text, schema)


def expand_metadata(
    df: DataFrame,
    column: str = "metadata",
    schema: T.StructType = schemas.RECORDING_METADATA,
    keep_before: tuple[str, ...] = ("video_id", "vin"),
    keep_after: tuple[str, ...] = ("recording_duration",),
) -> DataFrame:
    """Parsed JSON fields as columns between the kept columns."""
    parsed = df.withColumn("_parsed", parse_metadata(F.col(column), schema))
    return parsed.select(*keep_before, "_parsed.*", *keep_after)
