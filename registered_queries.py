"""Every operator as a query over the test tables, with its SQL where SQL can say it.

The inputs of the operators (device ids, date texts, code columns, JSON) are
derived from the tables by Spark, on all of their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori import jobs, names, schemas
from tsukiori.catalog.crawl import (
    column_mapping_table,
    crawl_directory,
    crawl_table,
    register_external_table,
)
from tsukiori.catalog.types import infer_column_types
from tsukiori.functions.dates import (
    day_of_month,
    parse_start_time,
    to_iso8601,
    year_month_int,
    year_month_text,
)
from tsukiori.functions.identifiers import management_id
from tsukiori.functions.metadata import parse_metadata
from tsukiori.functions import naming
from tsukiori.functions.naming import english_name_of
from tsukiori.operators import aggregate, geocode, lookup, quality, shape
from tsukiori.plans.access_points import access_point_list
from tsukiori.plans.connections import connection_log
from tsukiori.plans import recordings as recording_plan
from tsukiori.scratch import at_clean, new_path
from tsukiori.sinks import writers
from tsukiori.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MONTH = "202402"
ORDER_MONTH = "199803"
NO_BROADCAST = lookup.BroadcastLimit(rows=0, bytes=0)


def query(oracle: str | None = None, *, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL, under its own name or under ``name``."""

    def register(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------
# Inputs derived from the tables


def mac_text(key: Column) -> Column:
    """A device id per key: address with ``:``, address with ``-``, or plain."""
    digits = F.substring(F.md5(key.cast("string")), 1, 12)
    address = F.regexp_replace(digits, "(..)(?!$)", "$1:")
    return (
        F.when(key % 3 == 0, address)
        .when(key % 3 == 1, F.upper(F.replace(address, F.lit(":"), F.lit("-"))))
        .otherwise(digits)
    )


_PAIRS = ", ".join(f"substr(md5(cast(event_id as varchar)), {i}, 2)" for i in range(1, 12, 2))
MAC_SQL = f"""CASE event_id % 3 WHEN 0 THEN concat_ws(':', {_PAIRS})
    WHEN 1 THEN upper(concat_ws('-', {_PAIRS}))
    ELSE substr(md5(cast(event_id as varchar)), 1, 12) END"""
MANAGEMENT_ID_SQL = f"""CASE WHEN regexp_matches(apid, '{names.MAC_PATTERN}')
    THEN regexp_replace(apid, '[-:]', '', 'g') ELSE apid END"""


def events_of_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, two thirds of them one or two months later."""
    later = F.expr("ts + make_ym_interval(0, CAST(event_id % 3 AS INT))")
    return table(spark, sf_dir, "events").withColumn("ts", later)


EVENTS_SQL = """(SELECT * REPLACE (CAST(ts AS TIMESTAMP) + to_months(CAST(event_id % 3 AS INTEGER)) AS ts)
    FROM events) AS events"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as connections; errors have no device id, some times do not parse."""
    return events_of_months(spark, sf_dir).select(
        F.when(F.col("event_type") != "error", mac_text(F.col("event_id"))).alias("apid"),
        F.when(F.col("user_id") % 10 == 7, F.date_format("ts", "yyyy/MM/dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("start_time"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("user_attr"),
        F.col("event_type").alias("device_attr"),
        F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        year_month_text(F.col("ts")).alias("yearmonth"),
    )


CONNECTIONS_SQL = f"""connections AS (
  SELECT CASE WHEN event_type <> 'error' THEN {MAC_SQL} END AS apid,
    CASE WHEN user_id % 10 = 7 THEN strftime(ts, '%Y/%m/%d')
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start_time,
    'NATION_' || (user_id % 30) AS user_attr, event_type AS device_attr,
    'P' || (user_id % 5) AS provider, strftime(ts, '%Y%m') AS yearmonth
  FROM {EVENTS_SQL})"""


def user_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation name -> region name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("operator_user_attr"),
        F.col("r_name").alias("common_user_attr"),
        F.lit("国内").alias("label_ja"),
    )


USER_MASTER_SQL = """user_master AS (
  SELECT n_name AS operator_user_attr, r_name AS common_user_attr
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def device_master(spark: SparkSession) -> DataFrame:
    return readers.rows_to_df(
        spark,
        [("click", "ios"), ("view", "android"), ("purchase", "windows")],
        schemas.DEVICE_MASTER,
    )


DEVICE_MASTER_SQL = """device_master(operator_device_attr, common_device_attr) AS (
  VALUES ('click', 'ios'), ('view', 'android'), ('purchase', 'windows'))"""

CONNECTION_LOG_SQL = f"""connection_log AS (
  SELECT {MANAGEMENT_ID_SQL} AS mgmt_id, apid,
    CASE WHEN ts IS NOT NULL THEN start_time END AS start_time,
    coalesce(common_user_attr, '{names.OTHER}') AS user_attr,
    coalesce(common_device_attr, '{names.OTHER}') AS device_attr,
    CAST(year(ts) * 100 + month(ts) AS INTEGER) AS year_month,
    CAST(day(ts) AS INTEGER) AS day, provider
  FROM (SELECT *, try_strptime(start_time, '%Y-%m-%d %H:%M:%S') AS ts FROM connections
        WHERE apid IS NOT NULL AND yearmonth = '{MONTH}')
  LEFT JOIN user_master ON user_attr = operator_user_attr
  LEFT JOIN device_master ON device_attr = operator_device_attr)"""


def date_text(ts: Column, key: Column) -> Column:
    """A timestamp in one of the nine accepted layouts, by key."""
    layouts = [
        "yyyy/MM/dd", "yyyy/M/d H:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSSSSS",
        "yyyy-MM-dd", "yyyy-M-d H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "yyyy-MM-dd'T'HH:mm:ss",
    ]
    text = F.date_format(ts, layouts[0])
    for i, layout in enumerate(layouts[1:], start=1):
        text = F.when(key % 9 == i, F.date_format(ts, layout)).otherwise(text)
    return text


ISO_SQL = """CASE
    WHEN event_id % 9 IN (0, 4) THEN strftime(ts, '%Y-%m-%dT00:00:00')
    WHEN event_id % 9 IN (1, 5) THEN strftime(ts, '%Y-%m-%dT%H:%M:00')
    WHEN event_id % 9 IN (3, 7) AND microsecond(ts) % 1000000 <> 0
      THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END"""


def with_address(customers: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and market segment of rows with customer columns."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .withColumnsRenamed(
            {"r_name": "prefecture", "n_name": "city", "c_mktsegment": "address"}
        )
    )


ADDRESSES_SQL = """addresses AS (
  SELECT c_custkey, r_name AS prefecture, n_name AS city, c_mktsegment AS address,
    c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pairs of coordinates per address; one segment is not covered."""
    return (
        with_address(table(spark, sf_dir, "customer"), spark, sf_dir)
        .filter(F.col("address") != "MACHINERY")
        .select(
            "prefecture", "city", "address",
            (F.col("c_acctbal") / 100).alias("latitude"),
            (F.col("c_acctbal") / 50).alias("longitude"),
        )
    )


PLACES_SQL = """places AS (
  SELECT prefecture, city, address, min(balance) / 100 AS latitude, min(balance) / 50 AS longitude
  FROM addresses WHERE address <> 'MACHINERY' GROUP BY ALL)"""


def access_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as access points at the address of their user."""
    customer = table(spark, sf_dir, "customer")
    events = events_of_months(spark, sf_dir).join(
        customer, F.col("user_id") == F.col("c_custkey"), "left"
    )
    kind = F.col("event_type")
    return with_address(events, spark, sf_dir).select(
        mac_text(F.col("event_id")).alias("apid"),
        F.concat(F.lit("AP"), F.col("event_id").cast("string")).alias("ap_name"),
        F.when(kind != "signup", kind).otherwise("").alias("location"),
        "prefecture",
        "city",
        "address",
        F.get_json_object("props", "$.k").alias("additional_info"),
        F.when(kind != "click", F.col("value")).alias("latitude"),
        F.when(~kind.isin("click", "view"), F.col("value") / 2).alias("longitude"),
        kind.alias("status"),
        F.when(kind == "purchase", F.date_format("ts", "yyyy/M/d H:mm"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("start_time"),
        F.when(kind == "error", "unknown").alias("end_time"),
        F.lit("c").alias("category"),
        F.lit("o").alias("owner_attr"),
        F.lit("f").alias("facility_attr"),
        F.lit("").alias("station_attr"),
        F.concat(F.lit("P"), (F.col("user_id") % 5).cast("string")).alias("provider"),
        year_month_text(F.col("ts")).alias("yearmonth"),
    )


def status_master(spark: SparkSession) -> DataFrame:
    return readers.rows_to_df(
        spark, [("click", "運用中"), ("view", "運用中"), ("error", "停止")], schemas.STATUS_MASTER
    )


STATUS_MASTER_SQL = """status_master(operator_status, common_status) AS (
  VALUES ('click', '運用中'), ('view', '運用中'), ('error', '停止'))"""

ACCESS_POINT_ROWS_SQL = f"""access_points AS (
  SELECT {MAC_SQL} AS apid, 'AP' || event_id AS ap_name,
    nullif(CASE WHEN event_type <> 'signup' THEN event_type ELSE '' END, '') AS location,
    a.prefecture, a.city, a.address, json_extract_string(props, '$.k') AS additional_info,
    CASE WHEN event_type NOT IN ('click', 'view') THEN value ELSE p.latitude END AS latitude,
    CASE WHEN event_type NOT IN ('click', 'view') THEN value / 2 ELSE p.longitude END AS longitude,
    coalesce(common_status, '{names.OTHER}') AS status,
    CASE event_type WHEN 'purchase' THEN strftime(ts, '%Y-%m-%dT%H:%M:00')
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS start_time,
    CAST(NULL AS VARCHAR) AS end_time, 'c' AS category, 'o' AS owner_attr,
    'f' AS facility_attr, CAST(NULL AS VARCHAR) AS station_attr,
    CAST(strftime(ts, '%Y%m') AS INTEGER) AS year_month, 'P' || (user_id % 5) AS provider
  FROM {EVENTS_SQL} LEFT JOIN addresses a ON user_id = c_custkey
  LEFT JOIN places p ON a.prefecture = p.prefecture AND a.city = p.city AND a.address = p.address
  LEFT JOIN status_master ON event_type = operator_status
  WHERE strftime(ts, '%Y%m') = '{MONTH}')"""

GOOD_POINT_SQL = """location IS NOT NULL AND prefecture IS NOT NULL AND city IS NOT NULL
  AND address IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as recordings; the metadata of errors is no JSON."""
    k = F.get_json_object("props", "$.k")
    metadata = F.concat(
        F.lit('{"model": "M'), k, F.lit('", "driver_id": "D'), F.col("user_id").cast("string"),
        F.lit('", "scenario": "'), F.col("event_type"), F.lit('"}'),
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("VID"), F.col("event_id").cast("string")).alias("video_id"),
        F.concat(F.lit("VIN"), F.col("user_id").cast("string")).alias("vin"),
        F.when(F.col("event_type") == "error", "not json").otherwise(metadata).alias("metadata"),
        F.col("value").alias("recording_duration"),
    )


EXPANDED_SQL = """expanded AS (
  SELECT 'VID' || event_id AS video_id, 'VIN' || user_id AS vin,
    CASE WHEN event_type <> 'error' THEN 'M' || json_extract_string(props, '$.k') END AS model,
    CASE WHEN event_type <> 'error' THEN 'D' || user_id END AS driver_id,
    CASE WHEN event_type <> 'error' THEN event_type END AS scenario,
    value AS recording_duration
  FROM events)"""


def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
        year_month_text(F.col("o_orderdate")).alias("yearmonth"),
    )


ORDERS_SQL = """orders_by_month AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    strftime(o_orderdate, '%Y%m') AS yearmonth FROM orders)"""
ALL_ORDERS_SQL = f"WITH {ORDERS_SQL} SELECT * FROM orders_by_month"
ONE_MONTH_SQL = f"{ALL_ORDERS_SQL} WHERE yearmonth = '{ORDER_MONTH}'"


def orders_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = orders_by_month(spark, sf_dir)
    return orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])


def orders_with_texts(spark: SparkSession, sf_dir: str, breaks: bool = False) -> DataFrame:
    """Orders whose priorities hold quotes, commas, backslashes, blanks, and line breaks if asked."""
    kind, text = F.col("o_orderkey") % 6, F.col("o_orderpriority")
    tricky = (
        F.when(kind == 1, F.concat(F.lit('say "hi", '), text))
        .when(kind == 2, F.concat(F.lit("\\"), text, F.lit("\\")))
        .when(kind == 3, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(kind == 4, F.concat(F.lit('"'), text, F.lit('"')))
        .when(kind == 5, F.concat(text, F.lit("\n" if breaks else ","), text))
        .otherwise(text)
    )
    return orders_by_month(spark, sf_dir).withColumn("o_orderpriority", tricky)


def _texts_sql(breaks: bool = False) -> str:
    between = "chr(10)" if breaks else "','"
    return f"""WITH {ORDERS_SQL}, texts AS (SELECT * REPLACE (CASE o_orderkey % 6
      WHEN 1 THEN 'say "hi", ' || o_orderpriority WHEN 2 THEN '\\' || o_orderpriority || '\\'
      WHEN 3 THEN '  ' || o_orderpriority || ' ' WHEN 4 THEN '"' || o_orderpriority || '"'
      WHEN 5 THEN o_orderpriority || {between} || o_orderpriority
      ELSE o_orderpriority END AS o_orderpriority) FROM orders_by_month)
      SELECT * FROM texts"""


TEXTS_SQL, BROKEN_TEXTS_SQL = _texts_sql(), _texts_sql(breaks=True)
MONTH_TEXTS_SQL = f"{TEXTS_SQL} WHERE yearmonth = '{ORDER_MONTH}'"


def published(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Orders as the library reads what it publishes."""
    return readers.read_csv_table(spark, path, ORDER_SCHEMA, known={}, multi_line=multi_line)


# ---------------------------------------------------------------------------
# Projections, filters, cleaning


@query(ONE_MONTH_SQL)
def filter_month(spark, sf_dir):
    return shape.filter_month(orders_by_month(spark, sf_dir), ORDER_MONTH)


@query(f"""WITH {ORDERS_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(o_custkey AS INTEGER) AS customer, o_orderstatus AS status,
  CAST(trunc(o_totalprice) AS INTEGER) AS price, o_orderpriority,
  CAST(yearmonth AS INTEGER) AS yearmonth FROM orders_by_month""")
def apply_mapping(spark, sf_dir):
    return shape.apply_mapping(
        orders_by_month(spark, sf_dir),
        [
            ("o_orderkey", "bigint", "order_id", "string"),
            ("o_custkey", "bigint", "customer", "int"),
            ("o_orderstatus", "string", "status", "string"),
            ("o_totalprice", "double", "price", "int"),
            ("yearmonth", "string", "yearmonth", "int"),
            ("absent", "string", "nothing", "string"),
        ],
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return shape.select_columns(orders, ["o_totalprice", "o_custkey", "o_orderkey"])


@query(f"""SELECT o_orderkey, coalesce(c_mktsegment, '{names.OTHER}') AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def sql_transform(spark, sf_dir):
    return shape.sql_transform(
        spark,
        f"""SELECT o.o_orderkey, coalesce(c.c_mktsegment, '{names.OTHER}') AS segment
           FROM o LEFT OUTER JOIN c ON o.o_custkey = c.c_custkey""",
        {"o": table(spark, sf_dir, "orders"), "c": table(spark, sf_dir, "customer")},
    )


def _with_blanks(spark, sf_dir):
    event_type = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(event_type == "error", "").otherwise(event_type).alias("event_type"),
        F.when(event_type != "view", F.col("value")).alias("value"),
    )


_NULLED_SQL = """nulled AS (SELECT event_id, nullif(event_type, 'error') AS event_type,
  CASE WHEN event_type <> 'view' THEN value END AS value FROM events)"""


def _with_nulls(spark, sf_dir):
    return shape.blank_to_null(_with_blanks(spark, sf_dir))


@query(f"WITH {_NULLED_SQL} SELECT * FROM nulled")
def blank_to_null(spark, sf_dir):
    return shape.blank_to_null(_with_blanks(spark, sf_dir))


@query(f"WITH {_NULLED_SQL} SELECT * FROM nulled WHERE event_type IS NOT NULL AND value IS NOT NULL")
def drop_null_required(spark, sf_dir):
    return quality.drop_null_required(_with_nulls(spark, sf_dir), ["event_type", "value"])


@query(f"""WITH {_NULLED_SQL} SELECT *,
  CASE WHEN event_type IS NULL THEN 'event_type' ELSE 'value' END AS reasons
  FROM nulled WHERE event_type IS NULL OR value IS NULL""")
def select_rejects(spark, sf_dir):
    rejects = quality.select_rejects(_with_nulls(spark, sf_dir), ["event_type", "value"])
    return rejects.select(
        "event_id", "event_type", "value", F.array_join(quality.REASONS, ",").alias("reasons")
    )


@query(f"WITH {ORDERS_SQL} SELECT *, yearmonth AS year_month FROM orders_by_month")
def add_month_partition(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir).withColumnRenamed("yearmonth", "year_month")
    return shape.add_month_partition(orders)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    return shape.drop_columns(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderpriority"])


@query("SELECT least(10, count(*)) AS n FROM orders")
def preview(spark, sf_dir):
    """As many rows as asked for, all of them rows of the table."""
    orders = table(spark, sf_dir, "orders")
    seen = shape.preview(orders, 10).join(orders, orders.columns, "left_semi")
    return seen.agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Scalar functions


@query(f"""WITH devices AS (SELECT event_id, {MAC_SQL} AS apid FROM events)
  SELECT event_id, apid, {MANAGEMENT_ID_SQL} AS mgmt_id FROM devices""",
       name="management_id")
def management_ids(spark, sf_dir):
    devices = table(spark, sf_dir, "events").select(
        "event_id", mac_text(F.col("event_id")).alias("apid")
    )
    return devices.withColumn("mgmt_id", management_id(F.col("apid")))


@query(f"SELECT event_id, {ISO_SQL} AS iso FROM events",
       name="to_iso8601")
def iso_dates(spark, sf_dir):
    texts = table(spark, sf_dir, "events").select(
        "event_id", date_text(F.col("ts"), F.col("event_id")).alias("text")
    )
    return texts.select("event_id", to_iso8601(F.col("text")).alias("iso"))


@query(f"""WITH {CONNECTIONS_SQL} SELECT start_time,
  CAST(year(ts) * 100 + month(ts) AS INTEGER) AS year_month, CAST(day(ts) AS INTEGER) AS day
  FROM (SELECT start_time, try_strptime(start_time, '%Y-%m-%d %H:%M:%S') AS ts FROM connections)""")
def year_month_day(spark, sf_dir):
    start = parse_start_time(F.col("start_time"))
    return connections(spark, sf_dir).select(
        "start_time", year_month_int(start).alias("year_month"), day_of_month(start).alias("day")
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(NULL AS VARCHAR) AS missing FROM events""",
       name="parse_metadata")
def parsed_metadata(spark, sf_dir):
    schema = T.StructType().add("k", T.IntegerType()).add("missing", T.StringType())
    parsed = table(spark, sf_dir, "events").withColumn(
        "p", parse_metadata(F.col("props"), schema)
    )
    return parsed.select("event_id", "p.*")


@query("""WITH headers AS (SELECT c_custkey, CASE c_custkey % 4
    WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || ' Total-' || c_nationkey
    WHEN 2 THEN '顧客' || c_name ELSE '設置場所名称' END AS header FROM customer)
  SELECT c_custkey, CASE WHEN header = '設置場所名称' THEN 'location'
    WHEN header LIKE '顧客%' THEN 'column_' || substr(md5(header), 1, 4)
    ELSE translate(lower(header), ' -', '__') END AS english FROM headers""", name="english_names")
def translated_names(spark, sf_dir):
    key = F.col("c_custkey") % 4
    header = (
        F.when(key == 0, F.col("c_name"))
        .when(key == 1, F.concat("c_mktsegment", F.lit(" Total-"), F.col("c_nationkey")))
        .when(key == 2, F.concat(F.lit("顧客"), F.col("c_name")))
        .otherwise("設置場所名称")
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", english_name_of(header).alias("english")
    )


_HASHED = f"column_{hashlib.md5('顧客番号'.encode()).hexdigest()[:4]}"


@query(f"""SELECT c_custkey AS {_HASHED}, c_name AS location, c_nationkey AS nation_key,
  c_acctbal AS balance_total, c_mktsegment FROM customer""")
def translate_columns(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    return naming.translate_columns(
        customer.toDF("顧客番号", "設置場所名称", "Nation Key", "Balance-Total", "c_mktsegment")
    )


# ---------------------------------------------------------------------------
# Joins


@query(f"""WITH {USER_MASTER_SQL} SELECT event_id, coalesce(common_user_attr, '{names.OTHER}') AS code
  FROM events LEFT JOIN user_master ON 'NATION_' || (user_id % 30) = operator_user_attr""")
def lookup_code(spark, sf_dir):
    coded = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("code"),
    )
    master = user_master(spark, sf_dir)
    return lookup.lookup_code(coded, "code", master, "operator_user_attr", "common_user_attr")


@query(f"""WITH {STATUS_MASTER_SQL} SELECT event_id, coalesce(common_status, '{names.OTHER}') AS status
  FROM events LEFT JOIN status_master ON event_type = operator_status""")
def unify_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))
    return lookup.unify_status(rows, status_master(spark))


@query(f"""WITH {CONNECTIONS_SQL}, {USER_MASTER_SQL} SELECT start_time, device_attr, provider,
  coalesce(common_user_attr, '{names.OTHER}') AS user_attr
  FROM connections LEFT JOIN user_master ON user_attr = operator_user_attr""")
def unify_user_attr(spark, sf_dir):
    rows = connections(spark, sf_dir).drop("apid", "yearmonth")
    return lookup.unify_user_attr(rows, user_master(spark, sf_dir))


@query(f"""WITH {CONNECTIONS_SQL}, {DEVICE_MASTER_SQL} SELECT start_time, user_attr, provider,
  coalesce(common_device_attr, '{names.OTHER}') AS device_attr
  FROM connections LEFT JOIN device_master ON device_attr = operator_device_attr""")
def unify_device_attr(spark, sf_dir):
    rows = connections(spark, sf_dir).drop("apid", "yearmonth")
    return lookup.unify_device_attr(rows, device_master(spark))


@query("""SELECT o_orderkey, o_custkey, c_name, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def left_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    return lookup.left_lookup(orders, customers, ["o_custkey"])


@query("""SELECT event_id, user_id, c_name, c_mktsegment
  FROM events LEFT JOIN customer ON user_id = c_custkey AND event_type <> 'error'""")
def left_lookup_large(spark, sf_dir):
    """The plan for lookups beyond the broadcast limit."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment"
    )
    joined = lookup.left_lookup(
        events, customers, ["user_id"], needed=F.col("event_type") != "error", limit=NO_BROADCAST
    )
    return joined.drop("event_type")


@query("""SELECT event_id, user_id, CASE WHEN rare THEN c_name END AS c_name FROM
  (SELECT *, event_type = 'error' AND user_id % 4 = 0 AS rare FROM events)
  LEFT JOIN customer ON user_id = c_custkey""")
def left_lookup_reduced(spark, sf_dir):
    """The plan for a large lookup of which few keys occur."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    joined = lookup.left_lookup(
        events, customers, ["user_id"],
        needed=(F.col("event_type") == "error") & (F.col("user_id") % 4 == 0),
        limit=lookup.BroadcastLimit(rows=customers.count() - 1),
    )
    return joined.drop("event_type")


@query("""SELECT o.o_orderkey, o.o_custkey, p.o_orderpriority FROM orders o
  LEFT JOIN orders p ON o.o_orderkey = p.o_orderkey AND p.o_orderkey % 7 <> 0""")
def left_lookup_shuffled(spark, sf_dir):
    """The plan for a large lookup and keys of which none is frequent."""
    orders = table(spark, sf_dir, "orders")
    priorities = orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderpriority")
    return lookup.left_lookup(
        orders.select("o_orderkey", "o_custkey"), priorities, ["o_orderkey"], limit=NO_BROADCAST
    )


_SKEWED_SQL = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 10 <> 1 THEN user_id END
  AS user_id FROM events"""


def _skewed(spark, sf_dir):
    """Events of which a third has one user, and some have none."""
    user = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 10 != 1, F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", user.cast("bigint").alias("user_id"))


@query(f"""SELECT event_id, user_id, c_name FROM ({_SKEWED_SQL}) LEFT JOIN customer ON user_id = c_custkey""")
def left_lookup_split(spark, sf_dir):
    """The plan for a large lookup and a frequent key."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return lookup.left_lookup(_skewed(spark, sf_dir), customers, ["user_id"], limit=NO_BROADCAST)


@query(f"""SELECT event_id, user_id, c_name || k AS c_name FROM ({_SKEWED_SQL}) LEFT JOIN
  (SELECT c_custkey, c_name, k FROM customer, (VALUES (''), ('+'), ('-')) AS v(k)) ON user_id = c_custkey""")
def left_lookup_duplicates(spark, sf_dir):
    """The same where each key has three rows in the lookup."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array(*[F.concat("c_name", F.lit(k)) for k in ("", "+", "-")])).alias("c_name"),
    )
    return lookup.left_lookup(
        _skewed(spark, sf_dir), customers, ["user_id"], allow_duplicates=True, limit=NO_BROADCAST
    )


def _places_to_fill(spark, sf_dir):
    points = access_points(spark, sf_dir)
    return points.select("ap_name", *geocode.ADDRESS, "latitude", "longitude")


_GEOCODED_SQL = f"""WITH {ADDRESSES_SQL}, {PLACES_SQL}
  SELECT 'AP' || event_id AS ap_name, a.prefecture, a.city, a.address,
    CASE WHEN event_type NOT IN ('click', 'view') THEN value ELSE p.latitude END AS latitude,
    CASE WHEN event_type NOT IN ('click', 'view') THEN value / 2 ELSE p.longitude END AS longitude
  FROM events LEFT JOIN addresses a ON user_id = c_custkey
  LEFT JOIN places p ON a.prefecture = p.prefecture AND a.city = p.city AND a.address = p.address"""


@query(_GEOCODED_SQL)
def geocode_missing(spark, sf_dir):
    return geocode.geocode_missing(_places_to_fill(spark, sf_dir), gazetteer(spark, sf_dir))


@query(_GEOCODED_SQL)
def geocode_missing_large(spark, sf_dir):
    """The plan for gazetteers beyond the broadcast limit."""
    return geocode.geocode_missing(
        _places_to_fill(spark, sf_dir), gazetteer(spark, sf_dir), limit=NO_BROADCAST
    )


@query(f"WITH {ADDRESSES_SQL}, {PLACES_SQL} SELECT * FROM places")
def one_place_per_address(spark, sf_dir):
    return geocode.one_place_per_address(gazetteer(spark, sf_dir))


_UNRESOLVED_SQL = f"""WITH {ADDRESSES_SQL}, unresolved AS (
  SELECT DISTINCT prefecture, city, address FROM events JOIN addresses ON user_id = c_custkey
  WHERE event_type IN ('click', 'view') AND address = 'MACHINERY')"""


@query(f"{_UNRESOLVED_SQL} SELECT * FROM unresolved")
def unresolved_addresses(spark, sf_dir):
    return geocode.unresolved_addresses(
        _places_to_fill(spark, sf_dir), gazetteer(spark, sf_dir)
    )


@query(f"""{_UNRESOLVED_SQL} SELECT prefecture, city, address, balance / 100 AS latitude,
    balance / 50 AS longitude FROM addresses WHERE address <> 'MACHINERY'
  UNION ALL SELECT prefecture, city, address, CAST(length(prefecture) AS DOUBLE) AS latitude,
    CAST(length(city) AS DOUBLE) AS longitude FROM unresolved""")
def extend_gazetteer(spark, sf_dir):
    known = gazetteer(spark, sf_dir)
    unresolved = geocode.unresolved_addresses(_places_to_fill(spark, sf_dir), known)

    def resolve(addresses):
        return addresses.assign(
            latitude=addresses["prefecture"].str.len().astype(float), longitude=addresses["city"].str.len().astype(float)
        )

    return geocode.extend_gazetteer(known, unresolved, resolve, tasks=2)


# ---------------------------------------------------------------------------
# Aggregations


@query(f"""WITH {_NULLED_SQL} SELECT CAST(count(*) - count(event_type) AS BIGINT) AS event_type,
  CAST(count(*) - count(value) AS BIGINT) AS value FROM nulled""")
def null_counts(spark, sf_dir):
    return aggregate.null_counts(_with_nulls(spark, sf_dir), ["event_type", "value"])


@query('SELECT count(*) AS "rows" FROM lineitem')
def row_count(spark, sf_dir):
    return aggregate.row_count(table(spark, sf_dir, "lineitem"))


@query("""SELECT l_shipmode_key, round(sum(l_extendedprice), 2) AS total FROM
  (SELECT l_returnflag || l_linestatus AS l_shipmode_key, l_extendedprice FROM lineitem)
  GROUP BY ALL""")
def sum_by(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_key"), "l_extendedprice"
    )
    sums = aggregate.sum_by(lines, "l_shipmode_key", "l_extendedprice", "total")
    return sums.withColumn("total", F.round("total", 2))


@query('SELECT l_partkey, count(*) AS "count" FROM lineitem GROUP BY l_partkey')
def count_by(spark, sf_dir):
    return aggregate.count_by(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(f"WITH {ORDERS_SQL} SELECT DISTINCT yearmonth, o_orderstatus FROM orders_by_month")
def distinct_keys(spark, sf_dir):
    return aggregate.distinct_keys(orders_by_month(spark, sf_dir), ["yearmonth", "o_orderstatus"])


@query(f"""{ALL_ORDERS_SQL} WHERE yearmonth IN
  (SELECT DISTINCT yearmonth FROM orders_by_month ORDER BY 1 DESC LIMIT 3)""")
def retain_latest(spark, sf_dir):
    return aggregate.retain_latest(orders_by_month(spark, sf_dir), 3)


# ---------------------------------------------------------------------------
# Quality


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  o_orderpriority, strftime(o_orderdate, '%Y%m') AS yearmonth FROM orders""")
def check_contract(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir)
    shouting = orders.toDF(*[c.upper() for c in orders.columns])
    return quality.check_contract(shouting, sorted(orders.columns))


@query(ALL_ORDERS_SQL)
def check_not_empty(spark, sf_dir):
    return quality.check_not_empty(orders_by_month(spark, sf_dir), "orders")


@query(f"""WITH {CONNECTIONS_SQL} SELECT yearmonth, 'apid' AS reasons,
  CAST(json_object('apid', apid, 'start_time', start_time, 'user_attr', user_attr,
    'device_attr', device_attr, 'provider', provider, 'yearmonth', yearmonth) AS VARCHAR) AS "row"
  FROM connections WHERE apid IS NULL""")
def reject_report(spark, sf_dir):
    rejects = quality.select_rejects(connections(spark, sf_dir), names.CONNECTION_REQUIRED)
    report = quality.reject_report(rejects, "yearmonth")
    return report.select("yearmonth", F.array_join(quality.REASONS, ",").alias("reasons"), "row")


def _type_sql(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", CASE
        WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '-?\\d+')) THEN 'INT'
        WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '-?\\d+(\\.\\d+)?')) THEN 'DOUBLE'
        ELSE 'STRING' END AS type FROM {view}"""
        for i, c in enumerate(columns)
    )


_TYPED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(_type_sql("lineitem", _TYPED),
       name="infer_column_types")
def infer_types(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return infer_column_types(lines.select(*[F.col(c).cast("string").alias(c) for c in _TYPED]))


# ---------------------------------------------------------------------------
# Sources and sinks: written to a new folder, read back whole


ORDER_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderpriority", T.StringType()),
    T.StructField("yearmonth", T.StringType()),
])


@query(f"WITH {CONNECTIONS_SQL} SELECT * FROM connections")
def read_csv_table(spark, sf_dir):
    path = new_path(spark, "connections-csv")
    source = connections(spark, sf_dir)
    japanese = {english: header for header, english in names.ENGLISH_NAMES.items()}
    labelled = source.toDF(*[japanese[c] for c in source.columns])
    labelled.write.option("header", True).option("quoteAll", True).csv(path)
    return readers.read_csv_table(spark, path, schemas.CONNECTION)


@query(BROKEN_TEXTS_SQL)
def read_csv_lines(spark, sf_dir):
    """Cells with quotes, separators, blanks and line breaks come back as they were."""
    path = new_path(spark, "orders-lines")
    writers.write_csv(orders_with_texts(spark, sf_dir, breaks=True), path)
    return published(spark, path, multi_line=True)


@query(TEXTS_SQL)
def read_csv_options(spark, sf_dir):
    path = new_path(spark, "orders-semicolon")
    orders = orders_with_texts(spark, sf_dir)
    by_status = orders.withColumn("folder", F.col("o_orderstatus"))
    by_status.write.partitionBy("folder").options(
        header=True, sep=";", quote="'", escape="'", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return readers.read_csv_table(
        spark, path, ORDER_SCHEMA, known={}, sep=";", quote="'", escape="'", recurse=True
    )


@query(ALL_ORDERS_SQL)
def read_json_lines(spark, sf_dir):
    path = new_path(spark, "orders-json")
    orders_by_month(spark, sf_dir).write.json(path)
    return readers.read_json_lines(spark, path, ORDER_SCHEMA)


#: Every 7th order has a cell too many, others one too few, a price that is none, or a key beyond a long.
def _odd_lines(spark, sf_dir):
    orders = orders_by_month(spark, sf_dir)
    kind = F.col("o_orderkey") % 7
    cells = [F.col(c).cast("string") for c in orders.columns]
    price = F.when(kind == 2, F.lit("a lot")).otherwise(cells[3])
    key = F.when(kind == 3, F.concat(cells[0], F.lit("00000000000000000000"))).otherwise(cells[0])
    line = F.concat_ws(",", key, *cells[1:3], price, *cells[4:])
    line = F.when(kind == 0, F.concat(line, F.lit(",more"))).when(kind == 1, F.concat_ws(",", *cells[:4])).otherwise(line)
    return orders.columns, orders.select(line.alias("line"))


def _odd_csv(spark, sf_dir):
    path = new_path(spark, "orders-odd")
    columns, lines = _odd_lines(spark, sf_dir)
    lines.toDF(",".join(columns)).write.options(header=True, quote="", sep="\u0001").csv(path)  # lines as they are
    return readers.read_csv_checked(spark, path, ORDER_SCHEMA, known={})


@query(f"{ALL_ORDERS_SQL} WHERE o_orderkey % 7 > 3")
def read_csv_checked(spark, sf_dir):
    """The rows of an input in which others do not fit."""
    return _odd_csv(spark, sf_dir).rows


@query(f"""WITH {ORDERS_SQL} SELECT CASE o_orderkey % 7 WHEN 2 THEN 'o_totalprice' WHEN 3 THEN 'o_orderkey' ELSE 'record' END AS reason,
  o_orderkey % 7 AS kind, count(*) AS n FROM orders_by_month WHERE o_orderkey % 7 < 4 GROUP BY ALL""")
def read_csv_rejects(spark, sf_dir):
    """The other records, by what is wrong with them, with the key they can be told by."""
    rejects = _odd_csv(spark, sf_dir).rejects
    key = F.coalesce(F.get_json_object("record", "$.o_orderkey"), F.split("record", ",")[0])
    key = F.regexp_replace(key, "0{20}$", "").cast("long")
    return rejects.groupBy(F.array_join("reasons", ",").alias("reason"), (key % 7).alias("kind")).agg(F.count("*").alias("n"))


def _odd_json(spark, sf_dir):
    path = new_path(spark, "orders-odd-json")
    orders = orders_by_month(spark, sf_dir)
    kind = F.col("o_orderkey") % 7
    whole = F.to_json(F.struct("*"))
    line = F.when(kind == 0, F.expr("left(line, length(line) - 9)")).when(kind == 1, F.replace("line", F.lit('"o_totalprice":'), F.lit('"o_totalprice":"x",".":'))).otherwise(F.col("line"))
    orders.withColumn("line", whole).select(line.alias("value")).write.text(path)
    return readers.read_json_checked(spark, path, ORDER_SCHEMA)


@query(f"{ALL_ORDERS_SQL} WHERE o_orderkey % 7 > 1")
def read_json_checked(spark, sf_dir):
    """The lines of a JSON input that fit, where others are cut off or hold a text for a number."""
    return _odd_json(spark, sf_dir).rows


@query(f"""WITH {ORDERS_SQL} SELECT o_orderkey, 'record' AS reason FROM orders_by_month WHERE o_orderkey % 7 < 2""")
def read_json_rejects(spark, sf_dir):
    """The other lines, whole, with the key read from them."""
    key = F.regexp_extract("record", r'"o_orderkey":(\d+)', 1).cast("long")
    return _odd_json(spark, sf_dir).rejects.select(key.alias("o_orderkey"), F.array_join("reasons", ",").alias("reason"))


@query(f"""WITH {ORDERS_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN yearmonth < '199501' THEN NULL ELSE o_orderpriority END AS o_orderpriority, yearmonth FROM orders_by_month""")
def read_months_parquet(spark, sf_dir):
    """Months of three layouts as one frame: a column that came later, one that went, a type that changed."""
    path = new_path(spark, "orders-layouts")
    orders = orders_by_month(spark, sf_dir)
    early = orders.filter("yearmonth < '199501'").drop("o_orderpriority").withColumn("clerk", F.lit("x"))
    middle = orders.filter("yearmonth >= '199501' AND yearmonth < '199701'").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    for rows in (early, middle, orders.filter("yearmonth >= '199701'")):
        writers.write_partitioned(rows, path, ["yearmonth"], rebalance=True)
    return readers.read_months_parquet(spark, path, ORDER_SCHEMA).rows


@query(f"WITH {ORDERS_SQL} SELECT * FROM orders_by_month WHERE yearmonth IN (SELECT DISTINCT yearmonth FROM orders_by_month ORDER BY yearmonth DESC LIMIT 3)")
def retain_latest_listed(spark, sf_dir):
    """The latest months of a table, found from its directories."""
    path = new_path(spark, "orders-latest")
    writers.write_partitioned(orders_by_month(spark, sf_dir), path, ["yearmonth"], rebalance=True)
    rows = spark.read.schema(ORDER_SCHEMA).parquet(path)
    return aggregate.retain_latest(rows, 3, months=readers.partition_values(spark, path))


@query(ONE_MONTH_SQL)
def read_month_parquet(spark, sf_dir):
    path = new_path(spark, "orders-months")
    writers.write_partitioned(
        orders_by_month(spark, sf_dir), path, ["yearmonth"], rebalance=True
    )
    return readers.read_month_parquet(spark, path, ORDER_MONTH)


@query(ALL_ORDERS_SQL)
def read_catalog_table(spark, sf_dir):
    path = new_path(spark, "orders-catalog")
    orders_by_month(spark, sf_dir).write.option("header", True).csv(path)
    types = {f.name: f.dataType.simpleString() for f in ORDER_SCHEMA.fields}
    name = path.rsplit("/", 1)[1].replace("-", "_")
    register_external_table(spark, "default", name, types, path)
    at_clean(lambda: spark.sql(f"DROP TABLE IF EXISTS `default`.`{name}`"))
    return readers.read_catalog_table(spark, "default", name)


@query(ALL_ORDERS_SQL)
def read_first_available(spark, sf_dir):
    path = new_path(spark, "orders-alternative")
    orders_by_month(spark, sf_dir).write.parquet(path)
    return readers.read_first_available(
        spark,
        [f"{path}-missing", path, f"{path}-never-tried"],
        lambda session, p: session.read.schema(ORDER_SCHEMA).parquet(p),
    )


@query(ALL_ORDERS_SQL)
def write_partitioned(spark, sf_dir):
    path = new_path(spark, "orders-partitioned")
    writers.write_partitioned(
        orders_by_month(spark, sf_dir), path, ["o_orderstatus"],
        compression="uncompressed", rebalance=True,
    )
    return spark.read.schema(ORDER_SCHEMA).parquet(path)


@query(f"""{ALL_ORDERS_SQL} WHERE yearmonth <> '{ORDER_MONTH}'
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, '9-NONE', yearmonth
  FROM orders_by_month WHERE yearmonth = '{ORDER_MONTH}'""")
def write_month_parquet(spark, sf_dir):
    """A second write of one month leaves the other months alone."""
    path = new_path(spark, "orders-rewrite")
    orders = orders_by_month(spark, sf_dir)
    writers.write_partitioned(orders, path, ["yearmonth"], rebalance=True)
    changed = shape.filter_month(orders, ORDER_MONTH).withColumn("o_orderpriority", F.lit("9-NONE"))
    writers.write_month_parquet(changed, path, ORDER_MONTH)
    return spark.read.schema(ORDER_SCHEMA).parquet(path)


@query(ONE_MONTH_SQL)
def replace_all(spark, sf_dir):
    """With ``replace_all`` the other months are gone after the second write."""
    path = new_path(spark, "orders-replace")
    orders = orders_by_month(spark, sf_dir)
    writers.write_partitioned(orders, path, ["yearmonth"], rebalance=True)
    month = shape.filter_month(orders, ORDER_MONTH)
    writers.write_month_parquet(month, path, ORDER_MONTH, replace_all=True)
    return spark.read.schema(ORDER_SCHEMA).parquet(path)


def _month_with_texts(spark, sf_dir, month=ORDER_MONTH):
    return shape.filter_month(orders_with_texts(spark, sf_dir), month)


@query(MONTH_TEXTS_SQL)
def write_month_csv(spark, sf_dir):
    root = new_path(spark, "orders-list")
    return published(spark, writers.write_month_csv(_month_with_texts(spark, sf_dir), root, ORDER_MONTH))


@query(MONTH_TEXTS_SQL)
def write_month_csv_single(spark, sf_dir):
    """The same as one file."""
    root = new_path(spark, "orders-list")
    path = writers.write_month_csv(_month_with_texts(spark, sf_dir), root, ORDER_MONTH, single_file=True)
    return published(spark, path)


@query(MONTH_TEXTS_SQL)
def replace_all_lists(spark, sf_dir):
    """With ``replace_all`` the lists of other months are gone."""
    root = new_path(spark, "orders-lists")
    writers.write_month_csv(_month_with_texts(spark, sf_dir, "199802"), root, "199802")
    writers.write_month_csv(_month_with_texts(spark, sf_dir), root, ORDER_MONTH, replace_all=True)
    return published(spark, f"{root}/{names.LIST_DIR}/*")


@query(TEXTS_SQL)
def write_csv_directory(spark, sf_dir):
    path = new_path(spark, "orders-directory") + "/orders.csv"
    writers.write_csv(orders_with_texts(spark, sf_dir), path)
    return published(spark, path)


@query(MONTH_TEXTS_SQL)
def write_backup_csv(spark, sf_dir):
    """Of two backups the later one is kept."""
    root = new_path(spark, "orders-backup")
    for month in ("199802", ORDER_MONTH):
        writers.write_backup_csv(_month_with_texts(spark, sf_dir, month), root, month, keep=1)
    return published(spark, f"{root}/{names.BACKUP_DIR}/*")


@query(MONTH_TEXTS_SQL)
def write_backup_csv_late(spark, sf_dir):
    """A backup of an earlier month, written last, is kept."""
    root = new_path(spark, "orders-backup")
    for month in ("199804", ORDER_MONTH):
        writers.write_backup_csv(_month_with_texts(spark, sf_dir, month), root, month, keep=1, single_file=True)
    return published(spark, f"{root}/{names.BACKUP_DIR}")


@query(ONE_MONTH_SQL)
def write_connection_csv(spark, sf_dir):
    root = new_path(spark, "orders-connection")
    month = shape.filter_month(orders_by_month(spark, sf_dir), ORDER_MONTH)
    writers.write_connection_csv(month.drop("yearmonth"), root, ORDER_MONTH, single_file=True)
    return spark.read.schema(ORDER_SCHEMA).option("header", True).csv(root)


@query(TEXTS_SQL)
def write_csv_quoted(spark, sf_dir):
    path = new_path(spark, "orders-quoted")
    writers.write_csv_quoted(orders_with_texts(spark, sf_dir), path)
    return published(spark, path)


@query("""SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY o_orderstatus""")
def sql_to_csv(spark, sf_dir):
    path = new_path(spark, "sql")
    source = f"parquet.`{sf_dir}/orders.parquet`"
    return writers.sql_to_csv(
        spark,
        f"""SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total
            FROM {source} GROUP BY o_orderstatus""",
        path,
    )


# ---------------------------------------------------------------------------
# Catalog


_CRAWLED_ORDERS_SQL = f"""SELECT * REPLACE (o_orderkey::INTEGER AS o_orderkey,
  o_custkey::INTEGER AS o_custkey, yearmonth::INTEGER AS yearmonth) FROM ({BROKEN_TEXTS_SQL})"""


@query(_CRAWLED_ORDERS_SQL, name="register_external_table")
def crawled_rows(spark, sf_dir):
    """A crawled and registered table has the types found and all rows."""
    folder = new_path(spark, "crawl")
    writers.write_csv(orders_with_texts(spark, sf_dir, breaks=True), f"{folder}/in/crawled_orders.csv")
    found = crawl_table(
        spark, f"{folder}/in/crawled_orders.csv", "crawled_orders", f"{folder}/out", multi_line=True
    )
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    register_external_table(spark, "default", name, found.types, found.location, multi_line=True)
    at_clean(lambda: spark.sql(f"DROP TABLE IF EXISTS `default`.`{name}`"))
    return readers.read_catalog_table(spark, "default", name)


def _new_database(spark, folder):
    database = "crawl_" + folder.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{folder}/database'")
    at_clean(lambda: spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE"))
    return database


@query("""SELECT c_acctbal AS balance, c_custkey::INTEGER AS id, c_name AS name, c_mktsegment AS segment
  FROM customer""")
def crawl_again(spark, sf_dir):
    """A second crawl finds other columns in another order, and the table has them."""
    folder = new_path(spark, "crawl")
    database = _new_database(spark, folder)
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    for columns in (["id", "name", "balance"], ["balance", "id", "segment", "name"]):
        writers.write_csv(customer.select(*columns), f"{folder}/in/crawled.csv")
        crawl_directory(spark, f"{folder}/in", database, f"{folder}/out", replace=True)
    return readers.read_catalog_table(spark, database, "crawled")


_CRAWLED_SQL = """SELECT 'crawled_customer' AS "table", e AS english, o AS original, t AS type, n
  FROM (VALUES ('column_' || substr(md5('顧客番号'), 1, 4), '顧客番号', 'INT'),
    ('c_name', 'c_name', 'STRING'), ('prefecture', '都道府県', 'INT'),
    ('balance_total', 'Balance-Total', 'DOUBLE'), ('category', 'カテゴリ', 'STRING')) AS v(e, o, t),
  (SELECT count(*) AS n FROM customer)
  UNION ALL SELECT 'crawled_supplier', c, c, t, n FROM
  (VALUES ('s_suppkey', 'INT'), ('s_name', 'STRING'), ('s_nationkey', 'INT'),
    ('s_acctbal', 'DOUBLE')) AS v(c, t), (SELECT count(*) AS n FROM supplier)"""


@query(_CRAWLED_SQL, name="crawl_directory")
def crawled_catalog(spark, sf_dir):
    """Names and types of a crawled directory, with the rows of each landed table."""
    folder = new_path(spark, "crawl")
    database = _new_database(spark, folder)
    customer = table(spark, sf_dir, "customer").toDF(
        "顧客番号", "c_name", "都道府県", "Balance-Total", "カテゴリ"
    )
    writers.write_csv(customer, f"{folder}/in/crawled_customer.csv")
    writers.write_csv(table(spark, sf_dir, "supplier"), f"{folder}/in/crawled_supplier.csv")
    found = crawl_directory(spark, f"{folder}/in", database, f"{folder}/out")
    parts = []
    for t in found:
        mapping = column_mapping_table(spark, t.mapping)
        types = spark.createDataFrame(list(t.types.items()), "english string, type string")
        rows = readers.read_catalog_table(spark, database, t.name).agg(F.count("*").alias("n"))
        parts.append(
            mapping.join(types, "english").withColumns(
                {"table": F.lit(t.name), "n": F.lit(rows.first()["n"])}
            )
        )
    return parts[0].union(parts[1]).withColumn("n", F.col("n").cast("bigint"))


# ---------------------------------------------------------------------------
# Plans and runs


@query(f"WITH {CONNECTIONS_SQL}, {USER_MASTER_SQL}, {DEVICE_MASTER_SQL}, {CONNECTION_LOG_SQL} "
       "SELECT * FROM connection_log",
       name="connection_log")
def connections_accepted(spark, sf_dir):
    return connection_log(
        connections(spark, sf_dir), user_master(spark, sf_dir), device_master(spark), MONTH
    ).accepted


@query(f"""WITH {CONNECTIONS_SQL} SELECT *, 'apid' AS reasons FROM connections
  WHERE apid IS NULL""")
def connection_log_rejects(spark, sf_dir):
    rejected = connection_log(
        connections(spark, sf_dir), user_master(spark, sf_dir), device_master(spark), MONTH
    ).rejected
    return rejected.withColumn("reasons", F.array_join(quality.REASONS, ",")).drop(quality.REASONS)


_POINTS_SQL = f"WITH {ADDRESSES_SQL}, {PLACES_SQL}, {STATUS_MASTER_SQL}, {ACCESS_POINT_ROWS_SQL}"
_POINT_COLUMNS_SQL = (
    f"SELECT {MANAGEMENT_ID_SQL} AS mgmt_id, * FROM access_points"
)


def _access_point_list(spark, sf_dir):
    return access_point_list(
        access_points(spark, sf_dir), status_master(spark), gazetteer(spark, sf_dir), MONTH
    )


@query(f"{_POINTS_SQL} {_POINT_COLUMNS_SQL} WHERE {GOOD_POINT_SQL}",
       name="access_point_list")
def access_points_accepted(spark, sf_dir):
    return _access_point_list(spark, sf_dir).accepted


_REASONS_SQL = ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c}' END"
    for c in ("location", "prefecture", "city", "address", "latitude", "longitude")
)


@query(f"""{_POINTS_SQL} {_POINT_COLUMNS_SQL.replace('*', f"*, concat_ws(',', {_REASONS_SQL}) AS reasons")}
  WHERE NOT ({GOOD_POINT_SQL})""")
def access_point_list_rejects(spark, sf_dir):
    rejected = _access_point_list(spark, sf_dir).rejected
    return rejected.withColumn("reasons", F.array_join(quality.REASONS, ",")).drop(quality.REASONS)


@query(f"WITH {EXPANDED_SQL} SELECT * FROM expanded")
def recording_expanded(spark, sf_dir):
    return recording_plan.recording_summary(recordings(spark, sf_dir)).expanded


@query(f"""WITH {EXPANDED_SQL} SELECT scenario, round(sum(recording_duration), 2) AS total_duration
  FROM expanded GROUP BY scenario""")
def recording_summary(spark, sf_dir):
    sums = recording_plan.recording_summary(recordings(spark, sf_dir)).duration_by_scenario
    return sums.withColumn("total_duration", F.round("total_duration", 2))


@query(f'WITH {EXPANDED_SQL} SELECT model, count(*) AS "count" FROM expanded GROUP BY model')
def recording_counts(spark, sf_dir):
    return recording_plan.recording_summary(recordings(spark, sf_dir)).count_by_model


def _labelled(headers: dict[str, str], relation: str) -> str:
    labels = ", ".join(f'{c} AS "{label}"' for c, label in headers.items())
    return f"SELECT {labels} FROM {relation}"


@query(f"""WITH {CONNECTIONS_SQL}, {USER_MASTER_SQL}, {DEVICE_MASTER_SQL}, {CONNECTION_LOG_SQL}
  SELECT *, '{MONTH}' AS yearmonth FROM ({_labelled(names.CONNECTION_HEADERS, 'connection_log')})""")
def run_connection_log(spark, sf_dir):
    """The published Parquet month of a whole run."""
    output = f'{new_path(spark, "run-connections")}/log'
    jobs.run_connection_log(
        spark, connections(spark, sf_dir), user_master(spark, sf_dir), device_master(spark),
        output, MONTH,
    )
    return readers.read_month_parquet(spark, output, MONTH)


@query(f"""WITH {CONNECTIONS_SQL} SELECT yearmonth AS row_month, 'apid' AS reasons,
  CAST(json_object('apid', apid, 'start_time', start_time, 'user_attr', user_attr,
    'device_attr', device_attr, 'provider', provider, 'yearmonth', yearmonth) AS VARCHAR) AS "row"
  FROM connections WHERE apid IS NULL AND yearmonth IN ('202401', '202402')""")
def run_connection_rejects(spark, sf_dir):
    """The rejects of two runs over one input, each once."""
    output = f'{new_path(spark, "run-rejects")}/log'
    for month in ("202401", "202402"):
        jobs.run_connection_log(
            spark, connections(spark, sf_dir), user_master(spark, sf_dir), device_master(spark), output, month
        )
    entries = spark.read.parquet(f"{output}_rejects/rejects")
    return entries.select("row_month", F.array_join(quality.REASONS, ",").alias("reasons"), "row")


@query(f"""{_POINTS_SQL}, published AS ({_POINT_COLUMNS_SQL} WHERE {GOOD_POINT_SQL})
  SELECT *, '{MONTH}' AS yearmonth FROM ({_labelled(names.ACCESS_POINT_HEADERS, 'published')})""")
def run_access_point_list(spark, sf_dir):
    """The published common table of a whole run."""
    output = new_path(spark, "run-access-points")
    jobs.run_access_point_list(
        spark, access_points(spark, sf_dir), status_master(spark), gazetteer(spark, sf_dir),
        output, MONTH, keep_backups=1,
    )
    return readers.read_month_parquet(spark, f"{output}/{names.COMMON_DIR}", MONTH)
