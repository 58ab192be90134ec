"""Where intermediate tables go.

A table written to the shared folder of the cluster outlives the executors that
wrote it, and what reads it does not have to run its inputs again. What a session
has written there is deleted by ``clean``, at the end of a ``cleaned`` block, or
when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tsukiori.sinks import files

# Paths, and what else to do at the end, such as dropping a table.
_made: list[str | Callable[[], object]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, a folder of the warehouse.

    All executors share either.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused location below the scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def at_clean(do: Callable[[], object]) -> None:
    """Have something done when the tables made so far are deleted."""
    _made.append(do)


def stage(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet and read back; for results that are read lazily."""
    return _write(df, new_path(df.sparkSession, name))


@contextmanager
def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> Iterator[DataFrame]:
    """The same for the length of a block; the table is deleted at its end."""
    path = new_path(df.sparkSession, name)
    try:
        yield _write(df, path, partition_by)
    finally:
        files.delete(df.sparkSession, path)
        _made.remove(path)


@contextmanager
def staged_counted(
    df: DataFrame, name: str, counts: Mapping[str, Column], partition_by: tuple[str, ...] = ()
) -> Iterator[tuple[DataFrame, dict[str, int]]]:
    """The same, with aggregates of all its rows, taken by the job that writes them.

    They are of the tasks that write, which count once each, whatever is run
    again. So no job only counts.
    """
    seen = Observation()
    with staged(df.observe(seen, *[column.alias(key) for key, column in counts.items()]), name, partition_by) as rows:
        yield rows, seen.get


def clean(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables made by this driver, but for the first ``since`` that are left."""
    while len(_made) > since:
        last = _made.pop()
        files.delete(spark, last) if isinstance(last, str) else last()


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """A block at whose end all scratch tables made in it are deleted."""
    since = len(_made)
    try:
        yield
    finally:
        clean(spark, since)


def _write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may be gone by now
        if spark is not None:
            clean(spark)
