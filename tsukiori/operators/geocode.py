"""Coordinates for rows that lack them, from a table of known addresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsukiori import schemas
from tsukiori.operators.lookup import DEFAULT_LIMIT, BroadcastLimit, left_lookup, profile
from tsukiori.scratch import stage

ADDRESS = ("prefecture", "city", "address")


def geocode_missing(
    df: DataFrame, gazetteer: DataFrame, *, limit: BroadcastLimit = DEFAULT_LIMIT
) -> DataFrame:
    """Fill ``latitude`` and ``longitude`` where at least one of them is null or NaN.

    Such a row gets both values of its address, or two nulls if a part of the
    address is missing or the address is unknown. Other rows stay as they are.
    The gazetteer is grouped once, and what is measured is what is joined.
    """
    places = stage(one_place_per_address(gazetteer), "places")
    measured = profile(places, ADDRESS)
    found = {"latitude": "_found_lat", "longitude": "_found_lon"}
    joined = left_lookup(
        df, places.withColumnsRenamed(found), ADDRESS,
        needed=_missing() & _complete(), limit=limit, measured=measured,
    )
    filled = {
        "latitude": F.when(_missing(), F.col("_found_lat")).otherwise(F.col("latitude")),
        "longitude": F.when(_missing(), F.col("_found_lon")).otherwise(F.col("longitude")),
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def one_place_per_address(gazetteer: DataFrame, rank: str | None = None) -> DataFrame:
    """One pair of coordinates per address: the one of lowest rank, then the smallest."""
    best = F.struct(*([rank] if rank else []), "latitude", "longitude")
    return (
        _located(gazetteer, rank)
        .groupBy(*ADDRESS)
        .agg(F.min(best).alias("_best"))
        .select(*ADDRESS, "_best.latitude", "_best.longitude")
    )


def unresolved_addresses(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Distinct addresses that ``geocode_missing`` would look up in vain."""
    wanted = df.filter(_missing() & _complete()).select(*ADDRESS).distinct()
    return wanted.join(_located(gazetteer).select(*ADDRESS), list(ADDRESS), "left_anti")


def extend_gazetteer(
    gazetteer: DataFrame,
    unresolved: DataFrame,
    resolve: Callable[[pd.DataFrame], pd.DataFrame],
    tasks: int,
) -> DataFrame:
    """The gazetteer plus the addresses that ``resolve`` knows.

    ``resolve`` gets a batch of addresses and returns those it knows, with
    ``latitude`` and ``longitude``. It may call a service: at most ``tasks`` tasks
    run at a time, and the result is written once, so that whatever is computed
    from it later asks nothing again. Only a task that is lost asks again.
    """
    columns = schemas.GAZETTEER.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield resolve(batch)[columns]

    asked = unresolved.select(*ADDRESS).distinct().repartition(tasks, *ADDRESS)
    resolved = stage(asked.mapInPandas(run, schemas.GAZETTEER), "resolved")
    return gazetteer.select(*columns).union(resolved)


def _located(gazetteer: DataFrame, rank: str | None = None) -> DataFrame:
    columns = [*schemas.GAZETTEER.fieldNames(), *([rank] if rank else [])]
    return gazetteer.select(*columns).filter(~_missing())


def _missing() -> Column:
    """A coordinate that is null or NaN, as in the quality checks."""
    return reduce(or_, [F.col(c).isNull() | F.isnan(c) for c in ("latitude", "longitude")])


def _complete() -> Column:
    return reduce(and_, [F.col(c).isNotNull() & (F.col(c) != "") for c in ADDRESS])
