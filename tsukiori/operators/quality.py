"""Checks that stop a run, and rows kept apart with the reasons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori import names
from tsukiori.errors import ContractError, EmptyDataError

REASONS = "reject_reasons"
REJECT_MESSAGE = "row is not in the required form"


def check_contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame under the agreed column names, if it has these columns and no more.

    Names are compared without regard to case, as Spark resolves them.
    """
    present = {c.lower(): c for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    if len(df.columns) != len(columns):
        raise ContractError(f"expected {len(columns)} columns, found {len(df.columns)}")
    return df.select(*[F.col(f"`{present[c.lower()]}`").alias(c) for c in columns])


def check_not_empty(df: DataFrame, what: str) -> DataFrame:
    """The frame, if it has a row; looks for one row only."""
    if df.isEmpty():
        raise EmptyDataError(f"{what} has no rows")
    return df


def reject_reasons(df: DataFrame, required: Sequence[str]) -> Column:
    """Names of the required columns a row lacks; empty for a good row."""
    lacking = F.array(*[F.when(is_missing(df, c), F.lit(c)) for c in required])
    # Unlike array_compact, this is no lambda, so the stage stays in one codegen span.
    return F.array_except(lacking, F.array(F.lit(None).cast("string")))


def any_missing(df: DataFrame, required: Sequence[str]) -> Column:
    """True where a required value is missing; never null itself."""
    return reduce(or_, [is_missing(df, c) for c in required])


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a column of fractional numbers."""
    is_null = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        return is_null | F.isnan(column)
    return is_null


def drop_null_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required columns are all filled."""
    # Plain null tests reach the scan as pushed filters; na.drop does not.
    return df.filter(reduce(and_, [~is_missing(df, c) for c in required]))


def select_rejects(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The other rows, with the names of the columns they lack."""
    return df.filter(any_missing(df, required)).withColumn(REASONS, reject_reasons(df, required))


def reject_report(
    rejects: DataFrame, month_column: str, job_id: str | None = None
) -> DataFrame:
    """One row per rejected row: month, reasons, and the whole row as JSON.

    With a job id the columns of a log entry are added.
    """
    columns = [F.col(f"`{c}`") for c in rejects.columns if c != REASONS]
    whole_row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    report = [F.col(month_column).alias(names.PARTITION_COLUMN), F.col(REASONS),
              whole_row.alias("row")]
    if job_id is not None:
        report += [
            log_time().alias("logged_at"),
            F.lit(job_id).alias("job_id"),
            F.lit("WARN").alias("level"),
            F.lit(REJECT_MESSAGE).alias("message"),
        ]
    return rejects.select(*report)


def log_time() -> Column:
    """The wall clock of the log, whatever the session time zone is."""
    local = F.convert_timezone(None, F.lit(names.LOG_TIME_ZONE), F.localtimestamp())
    return F.date_format(local, names.LOG_TIME_FORMAT)
