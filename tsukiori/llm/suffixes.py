"""Which rows of a table of suffixes are repeated, by a distributed sort.

A suffix is given as words: its leading bytes as a number, a hash of a stretch
of it, and a hash of all that matters of it. Splitters that Spark samples cut the
order of the words into ranges; each range is a bucket, which one task sorts by
multikey quicksort; neighbours are compared, also across the buckets' bounds.
Equal suffixes of any number may so fill several buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsukiori.scratch import stage, staged_counted

#: The words of a suffix, and whose it is.
WORDS = ("lead", "key", "rest")
OWNER = ("id", "copy", "place")
#: Suffixes of a bucket, about, if there are more of them than the shuffle's partitions hold so.
BUCKET_ROWS = 1 << 20
SCHEMA = "lead long, key long, rest long, id long, copy long, place long"


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """The order by the first word, among equal ones by the second, and so on.

    Only what earlier words leave equal is sorted by a later one.
    """
    order = np.argsort(words[0])
    tied = np.arange(len(order))  # places in the order that earlier words do not tell apart
    run = np.zeros(len(order), np.int64)  # their runs of equal words
    for level, word in enumerate(words[:-1]):
        values = word[order[tied]]
        same = (values[1:] == values[:-1]) & (run[1:] == run[:-1])
        run = np.concatenate([[0], np.cumsum(~same)]) if len(values) else run
        many = np.zeros(len(tied), bool)
        many[1:] |= same
        many[:-1] |= same
        tied, run = tied[many], run[many]
        if not len(tied):
            break
        own = order[tied]
        order[tied] = own[np.lexsort((words[level + 1][own], run))]
    return order


def _equal_neighbours(words: list[np.ndarray]) -> np.ndarray:
    """For each row in order, whether it equals the one before or after in all words."""
    same = np.ones(max(len(words[0]) - 1, 0), bool)
    for word in words:
        same &= word[1:] == word[:-1]
    out = np.zeros(len(words[0]), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _firsts(words: list[np.ndarray]) -> np.ndarray:
    """Where runs of rows that are equal in all words start."""
    new = np.ones(len(words[0]), bool)
    new[1:] = False
    for word in words:
        new[1:] |= word[1:] != word[:-1]
    return new


def _states(words: list[np.ndarray]) -> np.ndarray:
    """States of the rows of a bucket (see ``repeated``), as far as it can tell."""
    state = _equal_neighbours(words[:2]).astype(np.int32) + _equal_neighbours(words)
    group, run = _firsts(words[:2]), _firsts(words)
    number = np.cumsum(group) - 1
    mixed = np.bincount(number, weights=run) > 1
    mixed[[0, -1]] = True  # it may go on in the next bucket
    state[run & (state == 2) & mixed[number]] = 3
    return state


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that equal a neighbour, and the first and last row."""
    parts = [batch for batch in batches if batch.num_rows]
    if not parts:
        return
    columns = [np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3)]
    owners = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(3, 6)]
    order = multikey_order(columns)
    columns = [c[order] for c in columns]
    state = _states(columns)
    edge = np.zeros(len(order), np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    out = np.flatnonzero((state > 0) | (edge > 0))
    yield pa.RecordBatch.from_arrays(
        [
            *[owner.take(pa.array(order[out])) for owner in owners],
            pa.array(state[out], pa.int32()),
            pa.array(edge[out], pa.int32()),
            *[pa.array(c[out], pa.int64(), mask=edge[out] == 0) for c in columns],
        ],
        names=[*OWNER, "state", "edge", *WORDS],
    )


def repeated(suffixes: DataFrame, name: str) -> DataFrame:
    """``id``, ``copy``, ``place`` and ``state`` of the suffixes that have another like them.

    State 1: another has the same ``lead`` and ``key``; 2 and 3: the same ``rest``
    as well. Of those equal in all three, at least one has state 3 if there are
    suffixes of the same ``lead`` and ``key`` that differ in ``rest``: it stands
    for them when those are looked at closer.

    The suffixes are written and counted in one job, so that splitters are sampled
    from the table, and the buckets are as many as their number asks for: a task
    holds the words of about ``BUCKET_ROWS`` rows at most, however many suffixes
    there are and however many of them are equal. The table is deleted once
    the buckets are sorted. Only the first and last row of each bucket come to the driver.
    """
    least = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with staged_counted(suffixes.select(*WORDS, *OWNER), f"{name}-suffixes", {"rows": F.count(F.lit(1))}) as (rows, seen):
        parts = max(least, -(-seen.get("rows", 0) // BUCKET_ROWS))
        ranged = rows.repartitionByRange(parts, *WORDS, *OWNER)
        found = ranged.mapInArrow(_bucket, f"id long, copy long, place long, state int, edge int, {SCHEMA.split(', id')[0]}")
        found = stage(found.withColumn("part", F.spark_partition_id()), name)
    edges = found.where("edge > 0").select("part", "edge", *WORDS).collect()
    first = {row["part"]: row for row in edges if row["edge"] & 1}
    last = {row["part"]: row for row in edges if row["edge"] & 2}
    order = sorted(first)
    raised: dict[tuple[int, int], int] = {}
    for before, after in zip(order[:-1], order[1:], strict=True):
        one, other = last[before], first[after]
        same = 0 if (one["lead"], one["key"]) != (other["lead"], other["key"]) else 3 if one["rest"] == other["rest"] else 1
        for part, edge in ((before, one["edge"]), (after, other["edge"])):
            raised[part, edge] = max(same, raised.get((part, edge), 0))
    rows = [(*at, state) for at, state in raised.items()]
    more = found.sparkSession.createDataFrame(rows, "part int, edge int, more int")
    joined = found.join(F.broadcast(more), ["part", "edge"], "left")
    return joined.select(*OWNER, F.greatest("state", F.coalesce("more", F.lit(0))).alias("state")).where("state > 0")
