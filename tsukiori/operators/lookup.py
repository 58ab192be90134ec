"""Left outer joins of a large table with a lookup of unknown size.

The lookup is measured first. Then one of three plans runs, all with the same
result:

1. The lookup is small: broadcast it. The large table is not shuffled.
2. The lookup is large, but few of its keys occur: one pre-aggregated pass over the
   key columns finds these, and their part of the lookup is broadcast.
3. Many keys occur: a shuffled join, after which each task should have about as
   many rows. A key that would give more than a task's share is dealt to several
   tasks by a salt, and its lookup rows go to each of these. Rows with nothing to
   look up are dealt by their content. So the large table is read once more, and
   no value of the lookup is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsukiori import names
from tsukiori.errors import DuplicateKeyError
from tsukiori.scratch import stage


@dataclass(frozen=True)
class BroadcastLimit:
    """The largest lookup that is broadcast."""

    rows: int = 500_000
    bytes: int = 64 * 1024 * 1024


DEFAULT_LIMIT = BroadcastLimit()


@dataclass(frozen=True)
class Profile:
    """Measured size of a lookup, its widest row, and the rows of its most repeated key."""

    rows: int
    bytes: int
    widest: int
    max_per_key: int

    def fits(self, limit: BroadcastLimit) -> bool:
        return self.rows <= limit.rows and self.bytes <= limit.bytes


def profile(lookup: DataFrame, keys: Sequence[str]) -> Profile:
    """Measure a lookup in one job; rows without a key match nothing and are left out."""
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in lookup.columns],
    )
    row = (
        lookup.filter(_filled(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(width).alias("bytes"),
            F.max(width).alias("widest"),
        )
        .agg(F.sum("n"), F.sum("bytes"), F.max("widest"), F.max("n"))
        .first()
    )
    return Profile(*[value or 0 for value in row])


def code_profiles(masters: Sequence[tuple[DataFrame, str]]) -> list[Profile]:
    """Measure several masters by their code columns, all at the same time."""
    with ThreadPoolExecutor(len(masters)) as pool:
        return list(pool.map(lambda master: profile(master[0], [master[1]]), masters))


def left_lookup(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    needed: Column | None = None,
    allow_duplicates: bool = False,
    limit: BroadcastLimit = DEFAULT_LIMIT,
    measured: Profile | None = None,
) -> DataFrame:
    """``df`` left outer joined with ``lookup`` on key columns of the same names.

    ``needed`` says which rows look anything up; the others get nulls. A key that
    has several lookup rows raises, unless ``allow_duplicates`` asks for the rows
    a plain join gives. Value columns need names that ``df`` does not have. A
    caller that knows the size of the lookup passes it as ``measured``.
    """
    clash = (set(lookup.columns) - set(keys)) & set(df.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    measured = measured or profile(lookup, keys)
    if measured.max_per_key > 1 and not allow_duplicates:
        raise DuplicateKeyError(
            f"a key of {list(keys)} has {measured.max_per_key} lookup rows"
        )
    values = [c for c in lookup.columns if c not in keys]
    lookup = lookup.filter(_filled(keys))
    if measured.fits(limit):
        return _broadcast_join(df, lookup, keys, values, needed)

    filled = _filled(keys)  # a null key matches nothing
    needed = filled if needed is None else F.coalesce(needed, F.lit(False)) & filled
    return _join_by_frequency(df, lookup, keys, values, needed, limit, measured)


def lookup_code(
    df: DataFrame,
    column: str,
    master: DataFrame,
    key: str,
    value: str,
    *,
    default: str = names.OTHER,
    allow_duplicates: bool = False,
    limit: BroadcastLimit = DEFAULT_LIMIT,
    measured: Profile | None = None,
) -> DataFrame:
    """Replace an operator's code by the common one, or by ``default`` where there is none."""
    codes = master.select(F.col(key).alias(column), F.col(value).alias("_common"))
    joined = left_lookup(
        df, codes, [column], allow_duplicates=allow_duplicates, limit=limit, measured=measured
    )
    common = F.coalesce(F.col("_common"), F.lit(default)).alias(column)
    return joined.select(*[common if c == column else F.col(c) for c in df.columns])


def unify_status(df: DataFrame, master: DataFrame, **options) -> DataFrame:
    """Common status labels for access points."""
    return lookup_code(df, "status", master, "operator_status", "common_status", **options)


def unify_user_attr(df: DataFrame, master: DataFrame, **options) -> DataFrame:
    """Common user attributes for connections."""
    return lookup_code(
        df, "user_attr", master, "operator_user_attr", "common_user_attr", **options
    )


def unify_device_attr(df: DataFrame, master: DataFrame, **options) -> DataFrame:
    """Common device attributes for connections."""
    return lookup_code(
        df, "device_attr", master, "operator_device_attr", "common_device_attr", **options
    )


def _filled(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def _join(df, lookup, keys, values, needed=None):
    renamed = lookup.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values)
    match = reduce(and_, [F.col(k) == F.col(f"_key_{k}") for k in keys])
    condition = match if needed is None else needed & match
    return df.join(renamed, condition, "left").select(*df.columns, *values)


def _broadcast_join(df, lookup, keys, values, needed=None):
    return _join(df, F.broadcast(lookup), keys, values, needed)


def _join_by_frequency(df, lookup, keys, values, needed, limit, measured):
    counts = df.filter(needed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if measured.max_per_key > 1:  # what counts is the rows that come out
        found = lookup.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
        counts = counts.join(found, list(keys), "left").withColumn("_n", F.col("_n") * F.coalesce("_m", F.lit(1)))
    counts = stage(counts.select(*keys, "_n"), "lookup-keys")
    distinct, most, total = counts.agg(F.count("*"), F.max("_n"), F.sum("_n")).first()
    rows = distinct * max(measured.max_per_key, 1)
    if rows <= limit.rows and rows * measured.widest <= limit.bytes:
        occurring = F.broadcast(counts.select(*keys))
        reduced = lookup.join(occurring, list(keys), "left_semi").select(*keys, *values)
        return _broadcast_join(df, reduced, keys, values, needed)
    return _salted_join(df, lookup, keys, values, needed, _salts(counts, keys, most, total, measured, limit))


def _salts(counts, keys, most, total, measured, limit):
    """Keys with more rows than a task's share, and their number of salts; None without such keys.

    A salt is a quarter of a task's share, so that salts that meet in one task do
    little harm. There are fewer such keys than tasks. If even these are more bytes than may
    be broadcast, the most frequent ones that fit.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not most or most * tasks <= total:
        return None
    fit = limit.bytes // max(measured.widest, 1) if limit.bytes else tasks
    most_keys = max(1, min(tasks, fit))
    hot = counts.filter(F.col("_n") * tasks > total).orderBy(F.desc("_n"), *keys).limit(most_keys)
    return hot.select(*keys, F.ceil(F.col("_n") * (4 * tasks) / total).cast("int").alias("_salts"))


def _salted_join(df, lookup, keys, values, needed, hot):
    content = F.xxhash64(*df.columns)
    if hot is None:
        salted, own = df, F.lit(0)
        lookup = lookup.withColumn("_salt", F.lit(0))
    else:
        salted = _broadcast_join(df, hot, keys, ["_salts"], needed)
        own = F.pmod(content, F.coalesce("_salts", F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        lookup = _broadcast_join(lookup, hot, keys, ["_salts"]).withColumn("_salt", F.explode(copies))
    # A salt below zero, which no lookup row has, for rows with nothing to look up.
    idle = -1 - F.pmod(content, F.lit(1 << 30)).cast("int")
    salted = salted.withColumn("_salt", F.when(needed, own).otherwise(idle))
    joined = _join(salted, lookup.select(*keys, "_salt", *values), [*keys, "_salt"], values)
    return joined.select(*df.columns, *values)
