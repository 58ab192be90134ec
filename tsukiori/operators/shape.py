"""Selecting, renaming and cleaning columns and rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.errors import NameCollisionError
from tsukiori.functions.dates import check_month

Mapping4 = tuple[str, str, str, str]


def filter_month(df: DataFrame, month: str, column: str = names.PARTITION_COLUMN) -> DataFrame:
    """Rows of one month; on a partition column this prunes the other partitions."""
    return df.filter(F.col(column) == F.lit(check_month(month)))


def apply_mapping(
    df: DataFrame, mappings: Iterable[Mapping4], keep_unlisted: bool = True
) -> DataFrame:
    """Rename and cast by ``(source, source type, target, target type)`` entries.

    An entry whose source column is missing is skipped. A value that does not
    fit the target type becomes null. Columns without an entry stay in place. Two
    entries for one source, or two columns that get one name, raise.
    """
    mappings = list(mappings)
    _check_unique("source columns mapped twice", [src for src, *_ in mappings])
    targets = {src.lower(): (dst, dst_type) for src, _, dst, dst_type in mappings}
    columns = []
    for field in df.schema.fields:
        target = targets.get(field.name.lower())
        if target is None:
            if keep_unlisted:
                columns.append(F.col(_quoted(field.name)))
            continue
        dst, dst_type = target
        columns.append(F.col(_quoted(field.name)).try_cast(dst_type).alias(dst))
    mapped = df.select(*columns)
    _check_unique("columns of one name", mapped.columns)
    return mapped


def _check_unique(what: str, found: Sequence[str]) -> None:
    count = Counter(name.lower() for name in found)
    if twice := sorted(name for name, n in count.items() if n > 1):
        raise NameCollisionError(f"{what}: {twice}")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The final columns in their final order."""
    return df.select(*[_quoted(c) for c in columns])


def relabel(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The columns of ``headers`` in its order, under its published labels."""
    return df.select(*[F.col(c).alias(label) for c, label in headers.items()])


def add_month_partition(df: DataFrame, source: str = "year_month") -> DataFrame:
    """Copy a month column into the partition column, as text."""
    return df.withColumn(names.PARTITION_COLUMN, F.col(source).cast("string"))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame without helper columns; names that are absent are ignored."""
    return df.drop(*columns)


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty strings become null in every text column, or in those named."""
    return df.replace("", None, subset=columns)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows, for a look at the data."""
    return df.limit(n)


def sql_transform(spark: SparkSession, query: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Result of a SQL text over frames known to it by alias.

    The aliases are temp views only while the text is analysed. A view that
    already has one of the names is put back afterwards.
    """
    shadowed = {
        alias: spark.table(alias)
        for alias in frames
        if spark.catalog.tableExists(alias) and spark.catalog.getTable(alias).isTemporary
    }
    try:
        for alias, frame in frames.items():
            frame.createOrReplaceTempView(alias)
        return spark.sql(query)
    finally:
        for alias in frames:
            spark.catalog.dropTempView(alias)
        for alias, frame in shadowed.items():
            frame.createOrReplaceTempView(alias)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
