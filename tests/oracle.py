"""Other ways to the same results: SQL in DuckDB, and dates by ``strptime``."""

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
}


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _rows(rows, columns, order):
    index = [columns.index(c) for c in order]
    return sorted((tuple(row[i] for i in index) for row in rows), key=repr)


def assert_same(frame, connection, sql):
    relation = connection.sql(sql)
    expected_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    actual_types = {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema.fields}
    assert actual_types == expected_types
    order = sorted(actual_types)
    actual = _rows(frame.collect(), frame.columns, order)
    expected = _rows(relation.fetchall(), relation.columns, order)
    assert len(actual) == len(expected)
    for a, e in zip(actual, expected, strict=True):
        for x, y in zip(a, e, strict=True):
            same = math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) and y is not None else x == y
            assert same, (a, e)


# Accepted layouts of date texts.
DATE_LAYOUTS = (
    "%Y/%m/%d",
    "%Y/%m/%d %H:%M",
    "%Y/%m/%d %H:%M:%S",
    "%Y/%m/%d %H:%M:%S.%f",
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M:%S",
)


def _parsed(text, layout):
    try:
        return datetime.strptime(text, layout)
    except ValueError:
        return None


def iso_by_strptime(text):
    """What ``to_iso8601`` must give: the first layout that parses decides."""
    moments = (_parsed(text, layout) for layout in DATE_LAYOUTS)
    return next((m.isoformat() for m in moments if m is not None), None)
