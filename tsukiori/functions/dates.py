"""Date texts and their parts, as native expressions.

None of the results depends on the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.errors import MonthError

# Blanks accepted between date and time, the ideographic space included.
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
_BLANK = f"[{_BLANKS}]"
# One or two digits per field; a one-digit day may be padded with a blank.
_MONTH = r"(?:1[0-2]|0?[1-9])"
_DAY = r"(?:3[01]|[12]\d|[0 ]?[1-9])"
_HOUR = r"(?:2[0-3]|[01]?\d)"
_SIXTY = r"[0-5]?\d"
_DATE_TEXT = (
    r"\A(?!0000)\d{4}"
    r"(?:"
    rf"(?:/{_MONTH}/{_DAY}|-{_MONTH}-{_DAY})"
    rf"(?:{_BLANK}+{_HOUR}:{_SIXTY}(?::{_SIXTY}(?:\.\d{{1,6}})?)?)?"
    r"|"
    rf"-{_MONTH}-{_DAY}[Tt]{_HOUR}:{_SIXTY}:{_SIXTY}"
    r")\z"
)


def to_iso8601(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]`` for a date text, null for any other text.

    Accepted are ``/`` and ``-`` dates, alone or followed by blanks and ``H:M``,
    ``H:M:S`` or ``H:M:S.f``; and ``-`` dates with ``T`` and ``H:M:S``. A date
    that is not in the calendar gives null, as does a blank at either end. The
    fraction is printed with six digits when it is not zero.
    """
    # The pattern settles what is accepted. The cast then reads one-digit fields
    # and knows the calendar; it wants "-" in dates and one blank before times.
    accepted = F.when(text.rlike(_DATE_TEXT), text)
    plain = F.translate(accepted, f"/Tt{_BLANKS}", "-" + " " * (2 + len(_BLANKS)))
    plain = F.replace(plain, F.lit("- "), F.lit("-"))
    date = F.substring_index(plain, " ", 1)
    time = F.ltrim(F.substring(plain, F.length(date) + 1, F.length(plain)))
    moment = F.concat(date, F.lit(" "), time).try_cast("timestamp_ntz").cast("string")
    # Only a fraction makes the text longer than 19; its zeros are cut.
    padded = F.when(F.length(moment) > 19, F.rpad(moment, 26, "0")).otherwise(moment)
    return F.replace(padded, F.lit(" "), F.lit("T"))


def parse_start_time(text: Column) -> Column:
    """Timestamp of a ``yyyy-MM-dd HH:mm:ss`` text, null where it does not parse."""
    return F.try_to_timestamp(text, F.lit(names.START_TIME_FORMAT))


def year_month_int(date: Column) -> Column:
    """``202501`` for a date in January 2025; null for null."""
    return F.year(date) * 100 + F.month(date)


def day_of_month(date: Column) -> Column:
    """Day of the month; null for null."""
    return F.dayofmonth(date)


def year_month_text(date: Column) -> Column:
    """``"202501"`` for a date in January 2025, the form of partition values."""
    return F.date_format(date, "yyyyMM")


def check_month(month: str) -> str:
    """The month argument, if it is six digits."""
    if not re.fullmatch(r"[0-9]{6}", month):
        raise MonthError(f"month must be six digits (YYYYMM), got {month!r}")
    return month
