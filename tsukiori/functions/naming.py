"""English column names for source headers, by one rule in two forms.

The rule: a known header has its agreed name; any other ASCII header becomes
lower case with ``_`` for blanks and ``-``; the rest becomes ``column_`` and the
first four hex digits of its MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.errors import NameCollisionError

_BOM = "\ufeff"


def english_name(header: str, known: Mapping[str, str] = names.ENGLISH_NAMES) -> str:
    """English name of one header."""
    header = header.removeprefix(_BOM)
    if header in known:
        return known[header]
    if header.isascii():
        return header.lower().replace(" ", "_").replace("-", "_")
    return "column_" + hashlib.md5(header.encode("utf-8")).hexdigest()[:4]


def english_name_of(header: Column, known: Mapping[str, str] = names.ENGLISH_NAMES) -> Column:
    """The same rule for headers that are data, such as a catalog of columns."""
    header = F.regexp_replace(header, f"^{_BOM}", "")
    agreed = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ascii_name = F.translate(F.lower(header), " -", "__")
    hashed = F.concat(F.lit("column_"), F.substring(F.md5(F.encode(header, "UTF-8")), 1, 4))
    return F.coalesce(
        F.try_element_at(agreed, header),
        F.when(header.rlike(r"\A[\x00-\x7F]*\z"), ascii_name).otherwise(hashed),
    )


def name_mapping(
    headers: Iterable[str], known: Mapping[str, str] = names.ENGLISH_NAMES
) -> dict[str, str]:
    """Source header -> English name, in order; two headers may not share a name."""
    mapping: dict[str, str] = {}
    owner: dict[str, str] = {}
    for header in headers:
        name = english_name(header, known)
        if name in owner:
            raise NameCollisionError(f"{owner[name]!r} and {header!r} both translate to {name!r}")
        owner[name] = header
        mapping[header] = name
    return mapping


def translate_columns(
    df: DataFrame, known: Mapping[str, str] = names.ENGLISH_NAMES
) -> DataFrame:
    """The frame under English column names."""
    return df.toDF(*name_mapping(df.columns, known).values())
