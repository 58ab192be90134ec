"""The monthly runs: read, check, publish. Also a command line for spark-submit.

Nothing is published before the month is known to hold rows. A month that goes to
several outputs is computed once, into a table in the scratch folder of the
cluster, which is deleted at the end. The job that writes this table counts its
rows, and what they lack, on the way; no job only counts.
"""

from __future__ import annotations

import argparse
import importlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tsukiori import names, schemas
from tsukiori.catalog.crawl import crawl_directory
from tsukiori.errors import EmptyDataError
from tsukiori.functions.dates import check_month
from tsukiori.operators import quality
from tsukiori.operators.geocode import extend_gazetteer, unresolved_addresses
from tsukiori.operators.shape import filter_month, relabel
from tsukiori.plans.access_points import access_point_rows
from tsukiori.plans.connections import connection_log
from tsukiori.plans.recordings import recording_summary
from tsukiori.scratch import cleaned, staged_counted
from tsukiori.sinks import writers
from tsukiori.sources.readers import (
    CheckedInput,
    conform,
    read_catalog_table,
    read_csv_checked,
    read_csv_table,
    read_csv_text,
    read_first_available,
    read_month_parquet,
    read_recordings,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunReport:
    """What a run did; ``missing`` has the empty values of each column of the month's rows.

    ``malformed`` counts the records of the whole input that did not fit its schema.
    """

    month: str
    accepted: int
    rejected: int
    missing: dict[str, int] = field(default_factory=dict)
    malformed: int = 0


def run_access_point_list(
    spark: SparkSession,
    access_points: DataFrame,
    status_master: DataFrame,
    gazetteer: DataFrame,
    output: str,
    month: str,
    *,
    job_id: str = "local",
    replace_all: bool = False,
    keep_backups: int | None = None,
    single_file: bool = False,
    resolve: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    resolve_tasks: int = 1,
    malformed: DataFrame | None = None,
) -> RunReport:
    """Publish the list, the common table and the backup of a month, and its rejects.

    With ``malformed``, the rejects of reading (see ``CheckedInput``), these are
    written too, under ``<output>/malformed`` in the part of this run's month.

    With ``resolve``, addresses that the gazetteer lacks are asked once each, in
    ``resolve_tasks`` tasks (see ``extend_gazetteer``). With ``replace_all`` the
    list and the table of all other months are deleted.
    """
    output = output.rstrip("/")
    with cleaned(spark):
        if resolve is not None:
            unresolved = unresolved_addresses(filter_month(access_points, month), gazetteer)
            gazetteer = extend_gazetteer(gazetteer, unresolved, resolve, resolve_tasks)
        rows = access_point_rows(access_points, status_master, gazetteer, month)
        required = names.ACCESS_POINT_REQUIRED
        tagged = rows.withColumns(
            {
                quality.REASONS: quality.reject_reasons(rows, required),
                "rejected": quality.any_missing(rows, required),
            }
        )
        unread = _write_malformed(malformed, output, month, job_id)
        counts = {"rejected": F.count_if("rejected"), "accepted": F.count_if(~F.col("rejected"))}
        counts |= {f"missing {c}": F.count_if(quality.is_missing(rows, c)) for c in rows.columns}
        with staged_counted(tagged, "access-points", counts, ("rejected",)) as (month_rows, seen):
            good = month_rows.filter(~F.col("rejected")).drop("rejected", quality.REASONS)
            bad = month_rows.filter("rejected").drop("rejected")
            accepted, rejected = seen["accepted"], seen["rejected"]
            if accepted + rejected == 0:
                raise EmptyDataError(f"no access points in month {month}")
            _write_rejects(bad, "year_month", output, month, job_id, rejected)
            if accepted == 0:
                raise EmptyDataError(f"no publishable access points in month {month}")
            missing = {c: seen[f"missing {c}"] for c in rows.columns}
            published = relabel(good, names.ACCESS_POINT_HEADERS)
            writers.write_month_csv(published, output, month, replace_all=replace_all, single_file=single_file)
            writers.write_partitioned(
                published.withColumn(names.PARTITION_COLUMN, F.lit(month)),
                f"{output}/{names.COMMON_DIR}",
                [names.PARTITION_COLUMN],
                compression="uncompressed",
                replace_all=replace_all,
            )
            writers.write_backup_csv(published, output, month, keep=keep_backups, single_file=single_file)
    return RunReport(month, accepted, rejected, missing, unread)


def run_connection_log(
    spark: SparkSession,
    connections: DataFrame,
    user_master: DataFrame,
    device_master: DataFrame,
    output: str,
    month: str,
    *,
    job_id: str = "local",
    format: str = "parquet",
    replace_all: bool = False,
    single_file: bool = False,
    malformed: DataFrame | None = None,
) -> RunReport:
    """Publish the connection log of a month, and the month's rows without a device id.

    Rejected rows are written even if no row of the month can be published.
    Those without a month go to a part of their own, which each run replaces.
    ``malformed``, the rejects of reading, go to ``<output>_rejects/malformed``.
    """
    output = output.rstrip("/")
    with cleaned(spark):
        checked = connection_log(connections, user_master, device_master, month)
        published = relabel(checked.accepted, names.CONNECTION_HEADERS)
        row_month = F.col(names.PARTITION_COLUMN)
        bad = checked.rejected.filter((row_month == month) | row_month.isNull())
        unread = _write_malformed(malformed, f"{output}_rejects", month, job_id)
        every = F.count(F.lit(1))
        with (
            staged_counted(bad, "rejects", {"own": F.count(row_month), "all": every}) as (bad, lost),
            staged_counted(published, "connections", {"rows": every}) as (rows, seen),
        ):
            accepted, rejected = seen["rows"], lost["own"]
            if accepted + lost["all"] == 0:
                raise EmptyDataError(f"no connections in month {month}")
            own, homeless = bad.filter(row_month.isNotNull()), bad.filter(row_month.isNull())
            _write_rejects(own, names.PARTITION_COLUMN, f"{output}_rejects", month, job_id, rejected)
            _write_rejects(homeless, names.PARTITION_COLUMN, f"{output}_rejects", "unknown", job_id, lost["all"] - rejected)
            if accepted == 0:
                raise EmptyDataError(f"no publishable connections in month {month}")
            if format == "csv":
                writers.write_connection_csv(rows, output, month, replace_all=replace_all, single_file=single_file)
            else:
                writers.write_month_parquet(rows, output, month, replace_all=replace_all)
    return RunReport(month, accepted, rejected, malformed=unread)


def _write_malformed(malformed: DataFrame | None, output: str, month: str, job_id: str) -> int:
    """Replace a run's table of records that could not be read as rows; returns their number."""
    if malformed is None:
        return 0
    seen = Observation()
    logged = malformed.withColumns({"logged_at": quality.log_time(), "job_id": F.lit(job_id)})
    with writers.replaced(malformed.sparkSession, f"{output}/malformed/{names.PARTITION_COLUMN}={month}") as written:
        logged.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(written)
    if seen.get["n"]:
        log.warning("job %s, month %s: %d records do not fit the input's schema", job_id, month, seen.get["n"])
    return seen.get["n"]


def _write_rejects(bad: DataFrame, month_column: str, output: str, month: str, job_id: str, rejected: int) -> None:
    """Replace the reject table of a month; only their number goes to the log."""
    directory = f"{output}/rejects/{names.PARTITION_COLUMN}={month}"
    entries = quality.reject_report(bad, month_column, job_id).withColumnRenamed(
        names.PARTITION_COLUMN, "row_month"
    )
    with writers.replaced(bad.sparkSession, directory) as written:
        entries.write.parquet(written)
    if rejected:
        log.warning("job %s, month %s: %d rows rejected", job_id, month, rejected)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tsukiori.jobs")
    commands = parser.add_subparsers(dest="command", required=True)

    monthly = argparse.ArgumentParser(add_help=False)
    monthly.add_argument("--month", required=True, type=check_month, help="YYYYMM")
    monthly.add_argument("--output", required=True)
    monthly.add_argument("--job-id", default="local")
    monthly.add_argument("--replace-all", action="store_true")
    monthly.add_argument("--single-file", action="store_true", help="CSV as one file, written by one task")

    dialect = argparse.ArgumentParser(add_help=False)
    dialect.add_argument("--sep", default=",")
    dialect.add_argument("--quote", default='"')
    dialect.add_argument("--escape", default='"', help="what stands before a quote in a quoted cell")
    dialect.add_argument("--multi-line", action="store_true", help="cells hold line breaks")

    points = commands.add_parser("access-points", parents=[monthly, dialect])
    source = points.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="access points, CSV")
    source.add_argument("--catalog-table", help="access points, DATABASE.TABLE")
    points.add_argument("--status-master", required=True, help="CSV")
    points.add_argument("--gazetteer", help="known addresses, Parquet")
    points.add_argument("--keep-backups", type=int)
    points.add_argument("--resolver", help="MODULE:FUNCTION that finds addresses the gazetteer lacks")
    points.add_argument("--resolver-tasks", type=int, default=1, help="tasks that call it at a time")

    connections = commands.add_parser("connections", parents=[monthly, dialect])
    source = connections.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="connections, CSV")
    source.add_argument("--input-table", help="Parquet with yearmonth= directories")
    connections.add_argument("--user-master", required=True, help="CSV")
    connections.add_argument("--device-master", required=True, help="CSV")
    connections.add_argument("--format", choices=["csv", "parquet"], default="parquet")

    crawl = commands.add_parser("crawl", parents=[dialect])
    crawl.add_argument("--input", required=True, help="directory of CSV files")
    crawl.add_argument("--database", required=True)
    crawl.add_argument("--warehouse", required=True)
    crawl.add_argument("--mappings")
    crawl.add_argument("--ddl", help="file for the statements")
    crawl.add_argument("--replace", action="store_true", help="tables may get other columns")

    recordings = commands.add_parser("recordings", parents=[dialect])
    recordings.add_argument("--input", required=True, nargs="+", help="CSV; the first that exists")
    recordings.add_argument("--output", required=True)

    sql = commands.add_parser("sql")
    sql.add_argument("--query", required=True)
    sql.add_argument("--output", help="directory for the whole result, CSV")

    quote = commands.add_parser("quote-csv", parents=[dialect])
    quote.add_argument("--input", required=True)
    quote.add_argument("--output", required=True)
    return parser.parse_args(argv)


def _dialect(args: argparse.Namespace) -> dict[str, object]:
    return {name: getattr(args, name) for name in ("sep", "quote", "escape", "multi_line")}


def _crawl(spark: SparkSession, args: argparse.Namespace) -> None:
    crawl_directory(
        spark, args.input, args.database, args.warehouse,
        mappings=args.mappings, ddl=args.ddl, replace=args.replace, **_dialect(args),
    )


def _named_function(name: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _access_points(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.input:
        source = read_csv_checked(spark, args.input, schemas.ACCESS_POINT, **_dialect(args))
    else:
        database, table = args.catalog_table.split(".", 1)
        source = CheckedInput(conform(read_catalog_table(spark, database, table), schemas.ACCESS_POINT), None)
    if args.gazetteer:
        gazetteer = spark.read.schema(schemas.GAZETTEER).parquet(args.gazetteer)
    else:
        gazetteer = spark.createDataFrame([], schemas.GAZETTEER)
    run_access_point_list(
        spark,
        source.rows,
        read_csv_table(spark, args.status_master, schemas.STATUS_MASTER, names.STATUS_MASTER_NAMES, **_dialect(args)),
        gazetteer,
        args.output,
        args.month,
        job_id=args.job_id,
        replace_all=args.replace_all,
        keep_backups=args.keep_backups,
        single_file=args.single_file,
        resolve=_named_function(args.resolver) if args.resolver else None,
        resolve_tasks=args.resolver_tasks,
        malformed=source.rejects,
    )


def _connections(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.input:
        source = read_csv_checked(spark, args.input, schemas.CONNECTION, **_dialect(args))
    else:
        source = CheckedInput(conform(read_month_parquet(spark, args.input_table, args.month), schemas.CONNECTION), None)
    run_connection_log(
        spark,
        source.rows,
        read_csv_table(spark, args.user_master, schemas.USER_MASTER, names.USER_MASTER_NAMES, **_dialect(args)),
        read_csv_table(spark, args.device_master, schemas.DEVICE_MASTER, names.DEVICE_MASTER_NAMES, **_dialect(args)),
        args.output,
        args.month,
        job_id=args.job_id,
        format=args.format,
        replace_all=args.replace_all,
        single_file=args.single_file,
        malformed=source.rejects,
    )


def _recordings(spark: SparkSession, args: argparse.Namespace) -> None:
    source = read_first_available(
        spark, args.input, lambda session, path: read_recordings(session, path, **_dialect(args))
    )
    summary = recording_summary(source)
    for name, df in {
        "expanded": summary.expanded,
        "duration_by_scenario": summary.duration_by_scenario,
        "count_by_model": summary.count_by_model,
    }.items():
        writers.write_csv(df, f"{args.output}/{name}")


def _sql(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.sql_to_csv(spark, args.query, args.output).show(20, truncate=False)


def _quote_csv(spark: SparkSession, args: argparse.Namespace) -> None:
    source = read_csv_text(spark, args.input, **_dialect(args))
    writers.write_csv_quoted(source, args.output)


_COMMANDS = {
    "access-points": _access_points,
    "connections": _connections,
    "crawl": _crawl,
    "recordings": _recordings,
    "sql": _sql,
    "quote-csv": _quote_csv,
}


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = (
        SparkSession.builder.appName(f"tsukiori {args.command}")
        # The JVM does not compile methods above this size; Spark then splits the stage.
        .config("spark.sql.codegen.hugeMethodLimit", 8000)
        .getOrCreate()
    )
    with cleaned(spark):
        _COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    main()
