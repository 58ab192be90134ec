"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, turned by a learned rotation, and cut to a sign a dimension:
64 bits. A code is four substrings of 16 bits, each with its own index. Codes
within a Hamming radius share, by the pigeonhole principle, a substring within a
quarter of it; so probing all substrings that near finds every such code. These
are then ranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsukiori.scratch import stage

#: Vectors, about, from which the rotation is learned, and queries by which the radius is set.
SAMPLE, CALIBRATION = 20_000, 100
#: Share of the true neighbours of the calibration queries that the radius must reach.
REACH = 0.98
#: Vectors of a block of the index, and queries of a block of queries.
INDEX_BLOCK, QUERY_BLOCK = 50_000, 5_000

_BITS, _TABLES, _WIDTH = 64, 4, 16
#: All substrings, from those of fewest bits; the first ``_WITHIN[r]`` have at most r.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << _WIDTH, dtype=np.uint32)), kind="stable").astype(np.int64)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << _WIDTH, dtype=np.uint32)).astype(np.int64)))


@dataclass
class Codes:
    """What turns vectors into codes."""

    mean: np.ndarray
    turn: np.ndarray

    def of(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((vectors - self.mean) @ self.turn > 0).astype(np.uint64)
        return (bits << np.arange(_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def learn(vectors: np.ndarray, rounds: int = 30) -> Codes:
    """Principal directions, then the rotation that brings them nearest to their signs.

    With fewer dimensions than bits, random directions make up for the rest.
    """
    random = np.random.default_rng(0)
    size = vectors.shape[1]
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(size)
    centred = vectors - mean
    _, directions = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(size))
    axes = directions[:, ::-1][:, :_BITS]
    if size < _BITS:
        axes = np.concatenate([axes, random.normal(size=(size, _BITS - size)) / np.sqrt(size)], axis=1)
    turned = centred @ axes
    rotation = np.linalg.qr(random.normal(size=(_BITS, _BITS)))[0]
    for _ in range(rounds if len(vectors) else 0):
        signs = np.where(turned @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ turned)
        rotation = (left @ right).T
    return Codes(mean, axes @ rotation)


class Index:
    """The tables of one block of vectors."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order, self.starts = [], []
        for table in range(_TABLES):
            values = self._part(codes, table)
            order = np.argsort(values, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(values[order], np.arange((1 << _WIDTH) + 1)))

    @staticmethod
    def _part(codes: np.ndarray, table: int) -> np.ndarray:
        return (codes >> np.uint64(_WIDTH * table) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of all codes within the radius, ascending."""
        found = np.zeros(len(self.codes), bool)
        least, more = divmod(radius, _TABLES)
        for table in range(_TABLES):
            near = least if table <= more else least - 1  # else the distances would sum to more than the radius
            if near < 0:
                continue
            own = int(self._part(np.array([code]), table)[0])
            values = _MASKS[: _WITHIN[min(near, _WIDTH)]] ^ own
            first, last = self.starts[table][values], self.starts[table][values + 1]
            count = last - first
            some = count > 0
            first, count = first[some], count[some]
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            found[self.order[table][at]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


def search_block(
    codes: Codes, radius: int, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query: ids and scores of its k nearest in the block that the index finds, but for the row of its key.

    The radius grows where it holds fewer than k.
    """
    index = Index(codes.of(vectors))
    for own, query, code in zip(query_keys, queries, codes.of(queries), strict=True):
        others = int(np.count_nonzero(keys != own))
        for reach in range(radius, _BITS + _TABLES, _TABLES):
            at = index.within(code, min(reach, _BITS))
            at = at[keys[at] != own]
            if len(at) >= min(k, others):
                break
        scores = (vectors[at] * query).sum(axis=1)  # row by row, so equal vectors have equal scores
        best = _best(scores, ids[at], k)
        yield ids[at][best], scores[best]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (array of double) of the vectors that take part.

    Without those that are null, zero, or hold a null or non-finite component,
    and those with a null id. Rows equal in both are one; ``key`` tells it from
    the others, of the same id too.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(f"`{id_col}`").isNotNull() & vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector")).distinct()
    return rows.withColumn("key", F.xxhash64("id", "vector"))


def _sampled(rows: DataFrame, every: int, wanted: int, salt: int) -> DataFrame:
    if every <= wanted:
        return rows
    share = int(wanted / every * (1 << 62))
    return rows.where(F.xxhash64(F.lit(salt), "id").bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(share))


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, size))


def _exact(rows: DataFrame, keys: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest rows of a few queries, by all scores; each task passes on k for each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for batch in batches:
            own, vectors = batch["key"].to_numpy(), _matrix(batch["vector"], queries.shape[1])
            for asked, query in zip(keys, queries, strict=True):
                part = pd.DataFrame({"query": asked, "id": batch["id"], "score": (vectors * query).sum(axis=1), "vector": batch["vector"]})
                part = pd.concat([best[asked], part[own != asked]]) if asked in best else part[own != asked]
                best[asked] = part.iloc[_best(part["score"].to_numpy(), part["id"].to_numpy(), k)]
        yield from best.values()

    found = rows.mapInPandas(run, "query long, id long, score double, vector array<double>")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _radius(rows: DataFrame, codes: Codes, every: int, k: int, reach: float) -> int:
    """The radius that holds a share of the true neighbours of a sample of rows."""
    sample = _sampled(rows, every, CALIBRATION, 2).toPandas()
    size = len(codes.mean)
    found = _exact(rows, sample["key"].to_numpy(), _matrix(sample["vector"], size), k).select("query", "vector").toPandas()
    if found.empty:
        return _BITS
    own = dict(zip(sample["key"], codes.of(_matrix(sample["vector"], size)), strict=True))
    mine = np.array([own[q] for q in found["query"]], np.uint64)
    apart = np.bitwise_count(mine ^ codes.of(_matrix(found["vector"], size)))
    return int(np.quantile(apart, reach, method="higher"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = REACH
) -> DataFrame:
    """For each query, the k nearest vectors by inner product that the index finds.

    Columns ``query_id`` (long), ``rank`` (int, from 1), ``vec_id`` (long) and
    ``score`` (double: the inner product of the vectors as given). Ties go to the
    smaller id; a query is not its own neighbour. A query has fewer than k rows
    only if there are fewer other vectors.

    Rotation and radius are learned on samples of about ``SAMPLE`` vectors and
    ``CALIBRATION`` queries, taken by a hash of the id; every vector is indexed
    and every query asked. Index and queries are cut into blocks by a hash of
    the id, and each task has one block of either; it passes on k rows a query.

    Vectors that take no part (see ``usable``) are neither queries nor found.
    Repeated rows count once. Several vectors of one id are each a candidate, of
    each other too, and each a query, with ranks of its own. A vector is compared
    with those of its length only; each length has an index of its own. Without
    vectors or queries there are no rows. Other columns are not looked at.
    """
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    asked = usable(queries, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("size")).count().orderBy("size").collect()
    found = None
    for row in lengths:
        of_length = (x.where(F.size("vector") == row["size"]) for x in (rows, asked))
        part = _nearest(*of_length, row["size"], row["count"], k, reach)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(rows: DataFrame, asked: DataFrame, size: int, every: int, k: int, reach: float) -> DataFrame:
    """The same for usable vectors of one length, of which there are ``every``."""
    codes = learn(_matrix(_sampled(rows, every, SAMPLE, 1).toPandas()["vector"], size))
    radius = _radius(rows, codes, every, k, reach)
    n_queries = asked.count()
    index_blocks, query_blocks = -(-every // INDEX_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    index = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(index_blocks)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"),
        "key", "id", "vector",
    )
    asking = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("i"),
        F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(query_blocks)).cast("int").alias("q"),
        "key", "id", "vector",
    )

    def run(own: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
        found = list(
            search_block(
                codes, radius, own["key"].to_numpy(), own["id"].to_numpy(), _matrix(own["vector"], size),
                those["key"].to_numpy(), _matrix(those["vector"], size), k,
            )
        )
        ids = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in found)])
        scores = np.concatenate([np.zeros(0), *(x[1] for x in found)])
        counts = [len(x[0]) for x in found]
        asked_by = {c: np.repeat(those[x].to_numpy(np.int64), counts) for c, x in (("key", "key"), ("query_id", "id"))}
        return pd.DataFrame(asked_by | {"vec_id": ids, "score": scores})

    found = (
        index.groupBy("i", "q")
        .cogroup(asking.groupBy("i", "q"))
        .applyInPandas(run, "key long, query_id long, vec_id long, score double")
    )
    place = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
