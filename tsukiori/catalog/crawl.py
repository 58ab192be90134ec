"""Turning a directory of CSV files into catalog tables.

The driver handles names only: files, columns and types. Reading, typing and
landing the rows are Spark jobs.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from tsukiori import names
from tsukiori.catalog.types import infer_column_types
from tsukiori.errors import ContractError
from tsukiori.functions.naming import name_mapping
from tsukiori.sinks import files
from tsukiori.sinks.writers import write_csv
from tsukiori.sources.readers import read_csv_text


#: Folder of a warehouse with a file for each table: what was crawled, and what came of it.
MANIFESTS = "_crawled"

# How landed files are written and registered tables are read: standard CSV.
LANDED_CSV = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


@dataclass(frozen=True)
class CrawledTable:
    """A table found by the crawler."""

    name: str
    location: str
    mapping: dict[str, str]
    types: dict[str, str]
    multi_line: bool = False

    def ddl(self, database: str) -> str:
        return table_ddl(database, self.name, self.types, self.location, self.multi_line)


def table_ddl(
    database: str, table: str, types: dict[str, str], location: str, multi_line: bool = False
) -> str:
    """Statement that registers a CSV directory with a header as an external table."""
    columns = ",\n".join(f"  `{name}` {type_}" for name, type_ in types.items())
    csv = LANDED_CSV | {"multiLine": "true"} if multi_line else LANDED_CSV
    options = ", ".join(f"{k} '{_escaped(v)}'" for k, v in csv.items())
    return (
        f"CREATE TABLE IF NOT EXISTS `{database}`.`{table}` (\n{columns}\n)\n"
        f"USING csv\nOPTIONS ({options})\nLOCATION '{_escaped(location)}'"
    )


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def register_external_table(
    spark: SparkSession, database: str, table: str, types: dict[str, str], location: str,
    *, multi_line: bool = False, replace: bool = False,
) -> None:
    """Register a CSV directory in the catalog, or point a table of these columns to it.

    Pointing it there is one change of the catalog, so the table is there at any
    time. A table of that name with other columns raises ``ContractError``, unless
    ``replace`` says to drop it. Files are never deleted.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    check_registered(spark, database, table, types, replace=replace)
    name = f"`{database}`.`{table}`"
    if spark.catalog.tableExists(name):
        if _registered_columns(spark, name) == _columns(types) and _reads_line_breaks(spark, name) == multi_line:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{_escaped(location)}'")
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")  # external: this leaves the files where they are
    spark.sql(table_ddl(database, table, types, location, multi_line))


def _columns(types: dict[str, str]) -> list[tuple[str, str]]:
    return [(name, type_.upper()) for name, type_ in types.items()]


def _registered_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType.upper()) for c in spark.catalog.listColumns(name)]


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    return {row["col_name"]: row["data_type"] for row in rows}


def _reads_line_breaks(spark: SparkSession, name: str) -> bool:
    return "multiline=true" in _described(spark, name).get("Storage Properties", "").lower()


def check_registered(
    spark: SparkSession, database: str, table: str, types: dict[str, str], *, replace: bool = False
) -> None:
    """Raise if the catalog has a table of this name that may not be replaced."""
    if not spark.catalog.tableExists(f"`{database}`.`{table}`"):
        return
    if spark.catalog.getTable(f"`{database}`.`{table}`").tableType != "EXTERNAL":
        raise ContractError(f"{database}.{table} is not an external table")
    registered = _registered_columns(spark, f"`{database}`.`{table}`")
    if registered != _columns(types) and not replace:
        raise ContractError(f"{database}.{table} has other columns: {registered}, found {list(types.items())}")


def column_mapping_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    """English and source name of every column of a table."""
    rows = [(english, source) for source, english in mapping.items()]
    return spark.createDataFrame(rows, "english string, original string")


def crawl_table(
    spark: SparkSession,
    path: str,
    table: str,
    warehouse: str,
    *,
    database: str | None = None,
    replace: bool = False,
    multi_line: bool = False,
    **csv_options,
) -> CrawledTable:
    """Type one CSV file or directory and land it in a new folder below ``warehouse/<table>``.

    With ``database``, a table of the catalog that has other columns stops this
    before anything is landed, unless ``replace`` is set.

    A manifest in the warehouse has the sizes and times of the files that were
    crawled. If they and the options are the same, and what was landed is
    still there, the files are not read again, and the same table is returned.
    """
    folder, kept = (f"{warehouse.rstrip('/')}/{name}" for name in (table, f"{MANIFESTS}/{table}.json"))
    seen = json.loads(json.dumps({"files": files.statuses(spark, path), "options": csv_options | {"multi_line": multi_line}}))
    manifest = json.loads(files.read_text(spark, kept) or "{}")
    if manifest.get("seen") == seen and files.exists(spark, f"{manifest['table']['location']}/_SUCCESS"):
        if database is not None:
            check_registered(spark, database, table, manifest["table"]["types"], replace=replace)
        return CrawledTable(**manifest["table"])
    source = read_csv_text(spark, path, multi_line=multi_line, **csv_options)
    mapping = name_mapping(source.columns)
    english = source.toDF(*mapping.values())
    found = {r["column"]: r["type"] for r in infer_column_types(english).collect()}
    types = {c: found[c] for c in english.columns}
    if database is not None:
        check_registered(spark, database, table, types, replace=replace)
    location = f"{folder}/version-{uuid.uuid4().hex}"
    english.write.options(**LANDED_CSV).csv(location)
    landed = CrawledTable(table, location, mapping, types, multi_line)
    files.write_text(spark, kept, json.dumps({"seen": seen, "table": asdict(landed)}))
    return landed


def crawl_directory(
    spark: SparkSession,
    directory: str,
    database: str,
    warehouse: str,
    *,
    mappings: str | None = None,
    ddl: str | None = None,
    replace: bool = False,
    concurrent: int = 4,
    **csv_options,
) -> list[CrawledTable]:
    """Every ``*.csv`` of a directory as a catalog table named after its file.

    A crawl that finds the columns a table already has lands its rows in a new
    folder and switches the table to it in one change. The folder before stays for
    those who still read it, until the next switch; older ones are deleted. If any
    table has other columns, nothing is switched, unless ``replace`` is set. Files
    that have not changed since the last crawl are not read.

    With ``mappings``, the source names of each table's columns are written there
    as ``<table>_mapping.csv``; with ``ddl``, the statements of the crawl to that
    file. Up to ``concurrent`` tables are crawled at once, so that many small
    files do not leave the cluster idle between their jobs. Further options say
    how the files are written, as for ``read_csv_text``.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def crawl(file: str) -> CrawledTable:
        name = file.removesuffix(".csv")
        table = crawl_table(
            spark, f"{directory}/{file}", name, warehouse, database=database, replace=replace, **csv_options
        )
        if mappings:
            columns = column_mapping_table(spark, table.mapping).toDF(*names.MAPPING_HEADERS)
            write_csv(columns, f"{mappings}/{name}_mapping.csv")
        return table

    found = [f for f in files.list_names(spark, directory) if f.endswith(".csv")]
    with ThreadPoolExecutor(concurrent) as pool:
        tables = list(pool.map(crawl, found))
    for table in tables:
        name = f"`{database}`.`{table.name}`"
        before = _described(spark, name).get("Location", "") if spark.catalog.tableExists(name) else ""
        folder, _, version = table.location.rpartition("/")
        if before.endswith(f"/{version}"):
            continue
        register_external_table(
            spark, database, table.name, table.types, table.location,
            multi_line=table.multi_line, replace=replace,
        )
        for old in files.list_names(spark, folder):
            if old not in (version, before.rpartition("/")[2]):
                files.delete(spark, f"{folder}/{old}")
    if ddl:
        files.write_text(spark, ddl, ddl_script(tables, database))
    return tables


def ddl_script(tables: list[CrawledTable], database: str) -> str:
    """The statements of a crawl as one text."""
    statements = [f"CREATE DATABASE IF NOT EXISTS `{database}`"]
    statements += [t.ddl(database) for t in tables]
    return ";\n\n".join(statements) + ";\n"
