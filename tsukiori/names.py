"""Names and values that published data and its readers depend on.

Everything in this module is a fixed value: source headers, published headers,
directory and file names, default labels and date layouts. Logic lives
elsewhere.
"""

from __future__ import annotations

# Source header -> English column name.
ENGLISH_NAMES = {
    "apid": "apid",
    "ap名称": "ap_name",
    "設置場所名称": "location",
    "都道府県": "prefecture",
    "市区町村": "city",
    "住所": "address",
    "補足情報": "additional_info",
    "緯度": "latitude",
    "経度": "longitude",
    "ステータス": "status",
    "利用開始日時": "start_time",
    "利用終了日時": "end_time",
    "カテゴリ": "category",
    "保有主体属性": "owner_attr",
    "施設属性": "facility_attr",
    "局属性": "station_attr",
    "事業者": "provider",
    "yearmonth": "yearmonth",
    "利用者属性": "user_attr",
    "端末属性": "device_attr",
}

# Headers of the lookup files -> English column name.
STATUS_MASTER_NAMES = {
    "各社ステータス": "operator_status",
    "共通ログステータス": "common_status",
}
USER_MASTER_NAMES = {
    "各社利用者属性": "operator_user_attr",
    "共通ログ利用者属性": "common_user_attr",
    "日本語表記": "label_ja",
}
DEVICE_MASTER_NAMES = {
    "各社端末属性": "operator_device_attr",
    "共通ログ端末属性": "common_device_attr",
}

# Published headers of the access-point list, in order.
ACCESS_POINT_HEADERS = {
    "mgmt_id": "管理ID",
    "apid": "APID",
    "ap_name": "AP名称",
    "location": "設置場所名称",
    "prefecture": "都道府県",
    "city": "市区町村",
    "address": "住所",
    "additional_info": "補足情報",
    "latitude": "緯度",
    "longitude": "経度",
    "status": "ステータス",
    "start_time": "利用開始日時",
    "end_time": "利用終了日時",
    "category": "カテゴリ",
    "owner_attr": "保有主体属性",
    "facility_attr": "施設属性",
    "station_attr": "局属性",
    "year_month": "年月",
    "provider": "事業者",
}

# Published headers of the connection log, in order.
CONNECTION_HEADERS = {
    "mgmt_id": "管理ID",
    "apid": "APID",
    "start_time": "利用開始日時",
    "user_attr": "利用者属性",
    "device_attr": "端末属性",
    "year_month": "年月",
    "day": "日",
    "provider": "事業者",
}

# Columns that must be filled for a row to be published.
ACCESS_POINT_REQUIRED = (
    "apid",
    "ap_name",
    "location",
    "prefecture",
    "city",
    "address",
    "latitude",
    "longitude",
    "status",
)
CONNECTION_REQUIRED = ("apid",)

# Fixed value: label of a code that has no entry in its lookup.
OTHER = "その他"

# Column, directory and file names of published data.
PARTITION_COLUMN = "yearmonth"
LIST_DIR = "list_ap_table"
BACKUP_DIR = "list_ap_backup"
COMMON_DIR = "common_ap"
LIST_FILE = "listap{month}.csv"
BACKUP_FILE = "backup_listap{month}.csv"
CONNECTION_FILE = "connection_data.csv"
MAPPING_HEADERS = ("英語カラム名", "元のカラム名")

# A hardware address inside a device id, and its separators.
MAC_PATTERN = "([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"
MAC_SEPARATORS = ":-"

# Fixed value: layout of start times in connection logs.
START_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Log time zone and layout.
LOG_TIME_ZONE = "Asia/Tokyo"
LOG_TIME_FORMAT = "yyyy/MM/dd HH:mm:ss"
