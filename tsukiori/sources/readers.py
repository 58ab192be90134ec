"""Readers. Known inputs have declared schemas; nothing infers types from data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori import names, schemas
from tsukiori.errors import EtlError, SourceNotFoundError
from tsukiori.functions.dates import check_month
from tsukiori.functions.naming import name_mapping
from tsukiori.operators.quality import check_contract
from tsukiori.sinks import files

#: The reason of a reject that is no record at all.
RECORD = "record"

_CORRUPT = "_corrupt_record"
#: Fixed value: the directory of rows without a value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def read_csv_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    header: bool = True,
    sep: str = ",",
    quote: str = '"',
    escape: str = '"',
    recurse: bool = False,
    multi_line: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """CSV with every column as text. Blank cells are null.

    Quotes in a quoted cell are doubled, as CSV libraries write them, unless
    another ``escape`` is named; blanks around a value are part of it. Cells may
    hold line breaks if ``multi_line`` says so, at the cost of a task per file.
    With a header, every file must have the header of the first one. With
    ``corrupt``, a column of that name has the whole record where it has more or
    fewer cells than there are columns; else such records are cut or filled up.
    """
    reader = spark.read.options(
        header=header, sep=sep, quote=quote, escape=escape,
        recursiveFileLookup=recurse, multiLine=multi_line,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    columns = reader.csv(paths).columns
    text = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    if corrupt is not None:
        text = text.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
    return reader.schema(text).option("enforceSchema", not header).csv(paths)


def read_csv_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    known: Mapping[str, str] = names.ENGLISH_NAMES,
    **options,
) -> DataFrame:
    """CSV of a known table: English names, declared types, columns found by header."""
    return conform(read_csv_text(spark, paths, **options), schema, known)


def read_recordings(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """CSV of recordings; their JSON cells hold quotes."""
    return read_csv_table(spark, paths, schemas.RECORDING, known={}, **options)


def conform(
    df: DataFrame, schema: T.StructType, known: Mapping[str, str] = names.ENGLISH_NAMES
) -> DataFrame:
    """The frame under English names and declared types; values that do not fit are null."""
    english = name_mapping([c.lower() for c in df.columns], known).values()
    agreed = check_contract(df.toDF(*english), schema.fieldNames())
    return agreed.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_month_parquet(
    spark: SparkSession, root: str, month: str, schema: T.StructType | None = None
) -> DataFrame:
    """One ``yearmonth=`` directory of a Parquet table, the month included as text.

    Only that directory is listed and read.
    """
    directory = f"{root.rstrip('/')}/{names.PARTITION_COLUMN}={check_month(month)}"
    reader = spark.read.options(basePath=root, mergeSchema=False)
    df = (reader.schema(schema) if schema else reader).parquet(directory)
    return df.withColumn(names.PARTITION_COLUMN, F.col(names.PARTITION_COLUMN).cast("string"))


def read_catalog_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    """A table of the session catalog."""
    return spark.table(f"`{database}`.`{table}`")


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """JSON with one object per line."""
    return spark.read.schema(schema).json(paths)


def read_first_available(
    spark: SparkSession,
    paths: Iterable[str],
    read: Callable[[SparkSession, str], DataFrame] = read_csv_text,
) -> DataFrame:
    """The first of several locations that loads: that exists and holds what ``read`` expects."""
    failures = []
    for path in paths:
        try:
            return read(spark, path)
        except AnalysisException as failure:
            failures.append(f"{path}: {failure.getCondition()}")
        except EtlError as failure:
            failures.append(f"{path}: {failure}")
    raise SourceNotFoundError("; ".join(failures) or "no location given")


def rows_to_df(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """Literal rows under a declared schema."""
    return spark.createDataFrame(list(rows), schema)


def partition_values(spark: SparkSession, root: str, column: str = names.PARTITION_COLUMN) -> list[str]:
    """The values of a table's first partition column, from the names of its directories; no file is read.

    Rows without a value, which have a directory of their own, are left out.
    """
    prefix = f"{column}="
    found = [unquote(name.removeprefix(prefix)) for name in files.list_names(spark, root) if name.startswith(prefix)]
    return sorted(value for value in found if value != _NO_VALUE)


@dataclass(frozen=True)
class CheckedInput:
    """What an input holds: rows that fit its schema, and the others.

    ``rejects`` has ``reasons`` (array of text: ``record`` for one that is no
    record of the input's columns, else the columns whose values do not fit) and
    ``record`` (as it was read; the cells as JSON where it could be taken apart).
    Neither is computed yet; each record is in exactly one of the two. ``rejects``
    is None for a source that has its types.
    """

    rows: DataFrame
    rejects: DataFrame | None


def read_csv_checked(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    known: Mapping[str, str] = names.ENGLISH_NAMES,
    **options,
) -> CheckedInput:
    """``read_csv_table`` with the records apart that do not fit.

    That is: more or fewer cells than the header has, or a cell that its column's
    declared type cannot hold. Blank cells fit any column.
    """
    text = read_csv_text(spark, paths, corrupt=_CORRUPT, **options)
    english = dict(zip((c for c in text.columns if c != _CORRUPT), name_mapping([c.lower() for c in text.columns if c != _CORRUPT], known).values(), strict=True))
    check_contract(text.drop(_CORRUPT).toDF(*english.values()), schema.fieldNames())
    named = text.select(*[F.col(f"`{c}`").alias(english.get(c, c)) for c in text.columns])
    present = {c.lower(): c for c in named.columns}
    cells = {f.name: F.col(f"`{present[f.name.lower()]}`") for f in schema.fields}
    typed = {f.name: cells[f.name].try_cast(f.dataType) for f in schema.fields}
    unfit = F.array(*[F.when(typed[c].isNull() & cells[c].isNotNull(), F.lit(c)) for c in cells])
    reasons = F.when(F.col(_CORRUPT).isNotNull(), F.array(F.lit(RECORD))).otherwise(F.array_compact(unfit))
    record = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*[cells[c].alias(c) for c in cells]), {"ignoreNullFields": "false"}))
    return CheckedInput(
        named.filter(F.size(reasons) == 0).select(*[typed[c].alias(c) for c in cells]),
        named.filter(F.size(reasons) > 0).select(reasons.alias("reasons"), record.alias("record")),
    )


def read_json_checked(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> CheckedInput:
    """``read_json_lines`` with the lines apart that are no objects, or hold a value that does not fit."""
    fields = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"}
    lines = spark.read.text(paths).select("value", F.from_json("value", fields, options).alias("read")).filter(F.trim("value") != "")
    unfit = F.col("read").isNull() | F.col(f"read.{_CORRUPT}").isNotNull()
    return CheckedInput(
        lines.filter(~unfit).select("read.*").drop(_CORRUPT),
        lines.filter(unfit).select(F.array(F.lit(RECORD)).alias("reasons"), F.col("value").alias("record")),
    )


@dataclass(frozen=True)
class Months:
    """Months read as one frame, and what their files had other than its columns.

    ``findings``: ``(month, column, finding)``, the finding being ``missing``,
    ``unknown`` (not read) or the type that was cast.
    """

    rows: DataFrame
    findings: list[tuple[str, str, str]]


def read_months_parquet(spark: SparkSession, root: str, schema: T.StructType, months: Iterable[str] | None = None) -> Months:
    """Several ``yearmonth=`` directories of a Parquet table whose columns changed over time.

    ``months`` are all that there are, unless named. The footers of each month are
    compared with the declared schema: a missing column is null, an unknown one is
    not read, and one of another type is cast, values that do not fit being null.
    Months with the same columns are one scan, so there are as many scans as there
    were changes. Columns of one month that no type holds in common raise.
    """
    root = root.rstrip("/")
    months = [check_month(m) for m in months] if months is not None else partition_values(spark, root)
    declared = [f for f in schema.fields if f.name != names.PARTITION_COLUMN]
    layouts: dict[str, tuple[T.StructType, list[str]]] = {}
    findings = []
    for month in months:
        found = spark.read.option("mergeSchema", True).parquet(f"{root}/{names.PARTITION_COLUMN}={month}").schema
        present = {f.name.lower(): f for f in found.fields}
        for field in declared:
            own = present.pop(field.name.lower(), None)
            if own is None:
                findings.append((month, field.name, "missing"))
            elif own.dataType != field.dataType:
                findings.append((month, field.name, own.dataType.simpleString()))
        findings += [(month, f.name, "unknown") for f in present.values()]
        layouts.setdefault(found.json(), (found, []))[1].append(month)
    rows = None
    for found, own in layouts.values():
        present = {f.name.lower(): f.name for f in found.fields}
        tagged = T.StructType([*found.fields, T.StructField(names.PARTITION_COLUMN, T.StringType())])
        paths = [f"{root}/{names.PARTITION_COLUMN}={month}" for month in own]
        part = spark.read.schema(tagged).option("basePath", root).parquet(*paths)
        part = part.select(*[
            F.col(f"`{present[f.name.lower()]}`").try_cast(f.dataType).alias(f.name) if f.name.lower() in present else F.lit(None).cast(f.dataType).alias(f.name)
            for f in declared
        ], names.PARTITION_COLUMN)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], T.StructType([*declared, T.StructField(names.PARTITION_COLUMN, T.StringType())]))
    return Months(rows, findings)
