"""Group-bys and counts. Each one is a partial aggregation before its shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.operators.quality import is_missing


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many values each column lacks; NaN counts as missing."""
    return df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])


def row_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def sum_by(df: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """Sum of a column per key."""
    return df.groupBy(key).agg(F.sum(value).alias(alias))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, in a column ``count``."""
    return df.groupBy(key).count()


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of the key columns."""
    return df.select(*columns).distinct()


def retain_latest(
    df: DataFrame, n: int = 1, column: str = names.PARTITION_COLUMN, months: Iterable[str] | None = None
) -> DataFrame:
    """Rows of the ``n`` latest months that occur, or of ``months`` if they are given.

    As constants the months prune the other partitions of a table. Given
    (``sources.readers.partition_values`` lists those of a table), no row is read
    to find them; else they, ``n`` values at most, are fetched first.
    """
    if months is None:
        found = distinct_keys(df, [column]).filter(F.col(column).isNotNull())
        latest = [row[0] for row in found.orderBy(F.desc(column)).limit(n).collect()]
    else:
        latest = sorted(set(months), reverse=True)[:n]
    return df.filter(F.col(column).isin(latest))
