"""Writers. All but single published files are written by many tasks."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.functions.dates import check_month
from tsukiori.sinks import files

# Standard CSV: quotes are doubled, and blanks around a value are part of it.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


@contextmanager
def replaced(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside the path to write to, which takes its place if the block ends well.

    If the block fails, what is at the path stays as it is. Readers of the folder
    above skip both names that are used on the way.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    written = f"{folder}/.{name}.parts-{uuid.uuid4().hex}"
    try:
        yield written
        files.publish(spark, written, path)
    finally:
        files.delete(spark, written)


def write_partitioned(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    *,
    format: str = "parquet",
    compression: str | None = None,
    replace_all: bool = False,
    rebalance: bool = False,
) -> None:
    """Write a table partitioned by ``keys``.

    Partitions that occur in ``df`` are replaced, each once all are written; the
    others stay, unless ``replace_all`` puts a new table in the place of the old
    one. ``rebalance`` shuffles by the keys to evenly sized files, splitting a
    large partition over several tasks.
    """
    if rebalance:
        df = df.hint("rebalance", *[F.col(k) for k in keys])
    writer = df.write.format(format).partitionBy(*keys)
    if compression:
        writer = writer.option("compression", compression)
    if format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if replace_all:
        with replaced(df.sparkSession, path) as written:
            writer.save(written)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def write_month_parquet(
    df: DataFrame,
    root: str,
    month: str,
    *,
    compression: str = "snappy",
    replace_all: bool = False,
) -> None:
    """Write the rows of one month into ``yearmonth=<month>``."""
    tagged = df.withColumn(names.PARTITION_COLUMN, F.lit(check_month(month)))
    write_partitioned(
        tagged, root, [names.PARTITION_COLUMN], compression=compression, replace_all=replace_all
    )


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write CSV with a header under exactly this path, replacing what is there.

    That is a directory of files, written in parallel, or with ``single_file`` one
    file, which one task writes. The number of rows has no say in it. Either is
    written beside its place and put there by a rename, once it is whole.
    """
    spark = df.sparkSession
    if not single_file:
        with replaced(spark, path) as written:
            df.write.options(**CSV_OPTIONS).csv(written)
        return
    folder, _, name = path.rstrip("/").rpartition("/")
    parts = f"{folder}/_{name}.parts-{uuid.uuid4().hex}"  # readers of the folder skip such names
    try:
        # Not coalesce(1): that would also run the steps before the write in one task.
        df.repartition(1).write.options(**CSV_OPTIONS).csv(parts)
        (part,) = [n for n in files.list_names(spark, parts) if n.startswith("part-")]
        files.move(spark, f"{parts}/{part}", path)
    finally:
        files.delete(spark, parts)


def write_month_csv(
    df: DataFrame, root: str, month: str, *, replace_all: bool = False, single_file: bool = False
) -> str:
    """Publish the access-point list of a month; returns the path.

    With ``replace_all`` the lists of all other months are deleted, once this one
    has been written.
    """
    name = names.LIST_FILE.format(month=check_month(month))
    folder = f"{root}/{names.LIST_DIR}"
    write_csv(df, f"{folder}/{name}", single_file=single_file)
    if replace_all:
        for other in _monthly(df.sparkSession, folder, names.LIST_FILE):
            if other != name:
                files.delete(df.sparkSession, f"{folder}/{other}")
    return f"{folder}/{name}"


def write_backup_csv(
    df: DataFrame, root: str, month: str, keep: int | None = None, *, single_file: bool = False
) -> str:
    """Back up the list of a month; with ``keep``, drop all but that many backups.

    This month's stays, whatever later ones there are, and the latest others.
    """
    folder = f"{root}/{names.BACKUP_DIR}"
    path = f"{folder}/{names.BACKUP_FILE.format(month=check_month(month))}"
    if keep is not None and keep < 1:
        raise ValueError("at least this month's backup is kept")
    write_csv(df, path, single_file=single_file)
    if keep is not None:
        drop_old_backups(df.sparkSession, folder, month, keep)
    return path


def drop_old_backups(spark: SparkSession, folder: str, month: str, keep: int) -> list[str]:
    """Delete all but the backup of a month and the ``keep - 1`` latest others; returns the names deleted."""
    own = names.BACKUP_FILE.format(month=check_month(month))
    others = [name for name in _monthly(spark, folder, names.BACKUP_FILE) if name != own]
    old = others[: max(len(others) - (keep - 1), 0)]
    for name in old:
        files.delete(spark, f"{folder}/{name}")
    return old


def _monthly(spark: SparkSession, folder: str, file: str) -> list[str]:
    """Published files of a folder, from the earliest month on."""
    return fnmatch.filter(files.list_names(spark, folder), file.format(month="[0-9]" * 6))


def write_connection_csv(
    df: DataFrame, root: str, month: str, *, replace_all: bool = False, single_file: bool = False
) -> str:
    """Publish the connection log of a month under ``yearmonth=<month>``; returns the path."""
    directory = f"{names.PARTITION_COLUMN}={check_month(month)}"
    path = f"{root}/{directory}/{names.CONNECTION_FILE}"
    write_csv(df, path, single_file=single_file)
    if replace_all:
        drop_other_months(df.sparkSession, root, month)
    return path


def drop_other_months(spark: SparkSession, root: str, month: str) -> None:
    """Delete the partitions of all other months, after this one has been written."""
    for name in files.list_names(spark, root):
        if name.startswith(f"{names.PARTITION_COLUMN}=") and not name.endswith(f"={month}"):
            files.delete(spark, f"{root}/{name}")


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """Write CSV with every cell in quotes; null and blank both become ``""``."""
    with replaced(df.sparkSession, path) as written:
        df.write.options(**CSV_OPTIONS, quoteAll=True).csv(written)


def sql_to_csv(spark: SparkSession, query: str, path: str | None = None) -> DataFrame:
    """Run a SQL text, optionally write its result as CSV, and return the whole result.

    What was written is read back, so the text does not run twice; blank and null
    cells stay apart in it, null being an empty cell and blank ``""``.
    """
    result = spark.sql(query)
    if path is None:
        return result
    write_csv(result, path)
    read_back = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\0", "multiLine": True}
    return spark.read.schema(result.schema).options(**read_back).csv(path)
