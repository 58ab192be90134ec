"""Ranked lexical search: term at a time, with a limit on accumulators.

Documents become postings of the query terms: for each document its length, and
the terms it holds with their numbers of occurrences. A task turns a batch of
them into inverted lists and takes an item's terms in turn, the rarest first. A
list opens accumulators for its documents only while a document that has none
yet could still reach the k-th best: the bounds of the lists to come are summed,
and once the sum is below the k-th partial score (or the k-th score of earlier
batches) later lists only add to the accumulators there are. So each survivor has
its exact score, and no document of the k best lacks an accumulator.

Scores are integers. A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``;
a document of n terms adds ``weight * (10**9 tf div (1000 tf + 20 m))`` for each
term, with ``m = 50 + 50 n N div L``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsukiori.llm import textbytes as tb
from tsukiori.scratch import stage

#: Pairs of item and term, about, that go to the tasks at a time.
BLOCK_TERMS = 200_000
#: Tasks whose best are merged at a time.
MERGED = 256

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The terms of a text in turn: runs of letters, digits and all beyond ASCII, A-Z in lower case."""
    plain = F.translate(text.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(plain, F.lit(_TERM), F.lit(0))


class Vocabulary:
    """The numbers of known terms, by two 64-bit hashes of their bytes."""

    def __init__(self, terms: list[str]):
        self.rolling = tb.Rolling(8), tb.Rolling(9)
        data, offsets = tb.utf8(pa.array(terms, pa.string()))
        hashes = self._hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes[0])
        self.hashes = hashes[:, self.order]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.stack([r.between(r.prefix(data), starts, ends) for r in self.rolling])

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for an unknown one."""
        if not len(self.order):
            return np.full(len(starts), -1)
        first, second = self._hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes[0], first), len(self.order) - 1)
        known = (self.hashes[0, at] == first) & (self.hashes[1, at] == second)
        return np.where(known, self.order[at], -1)


def postings(docs: DataFrame, terms: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document ``doc_id``, ``n`` (its terms with repeats), and of the given terms in it ``terms`` (numbers) and ``tfs``."""
    outputs = [
        T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ]
    vocabulary, size = Vocabulary(terms), max(len(terms), 1)

    def make() -> tb.Work:
        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            data = tb.LOWER[data]
            starts, ends = tb.runs(tb.ALNUM[data], offsets)
            bounds = tb.owners(starts, offsets)
            number = vocabulary.numbers(data, starts, ends)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            known = number >= 0
            pairs, tfs = np.unique(doc[known] * size + number[known], return_counts=True)
            per_doc = np.bincount(pairs // size, minlength=len(offsets) - 1)
            return [pa.array(np.diff(bounds), pa.int64()), tb.lists(pairs % size, per_doc, pa.int32()), tb.lists(tfs, per_doc, pa.int32())]

        return work

    source = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    return tb.per_document(source, "text", ["doc_id"], outputs, make)


@dataclass
class Best:
    """The k best documents of an item so far, best first."""

    k: int
    scores: np.ndarray
    ids: np.ndarray
    unnamed: np.ndarray

    @property
    def least(self) -> int:
        """The k-th score, 0 if there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.unnamed, unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Lists:
    """A batch of postings as inverted lists."""

    def __init__(self, n_docs: int, doc: np.ndarray, terms: np.ndarray, parts: np.ndarray):
        """``parts`` is what each posting adds for a weight of one."""
        order = np.argsort(terms, kind="stable")
        self.n_docs, self.doc, self.parts = n_docs, doc[order], parts[order]
        self.names, starts = np.unique(terms[order], return_index=True)
        self.bounds = np.append(starts, len(terms))
        self.most = np.maximum.reduceat(self.parts, starts) if len(starts) else np.zeros(0, np.int64)

    def scores(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> np.ndarray:
        """Scores of all documents that may be among the k best, if these have ``least`` at least; 0 for others.

        ``terms`` are those of one item, the rarest first.
        """
        at = np.minimum(np.searchsorted(self.names, terms), max(len(self.names) - 1, 0))
        here = (self.names[at] == terms) & (weights > 0) if len(self.names) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        totals = np.zeros(self.n_docs, np.int64)
        rest = np.cumsum((weights * self.most[at])[::-1])[::-1]  # the most that a list and those after it add
        opening = True
        for i, weight, bound in zip(at.tolist(), weights.tolist(), rest.tolist(), strict=True):
            if opening and bound < max(least, _kth(totals, k)):
                opening = False
            doc, parts = self.doc[self.bounds[i] : self.bounds[i + 1]], self.parts[self.bounds[i] : self.bounds[i + 1]]
            if not opening:
                open_ = totals[doc] > 0
                doc, parts = doc[open_], parts[open_]
            totals[doc] += weight * parts
        return totals


def _searched(rows: DataFrame, item_ids: pa.Array, item_terms: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int, kind: T.DataType) -> DataFrame:
    """Of each task the k best documents of each item."""
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, *(np.zeros(0, x) for x in (np.int64, np.int64, bool))) for _ in item_terms]
        for batch in batches:
            names, sizes, terms, tfs = batch.columns
            unnamed = np.asarray(names.is_null())
            ids = names.fill_null(0).to_numpy()
            m = 50 + 50 * sizes.to_numpy() * n // total
            doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            tf = tfs.flatten().to_numpy().astype(np.int64)
            parts = 10**9 * tf // (1000 * tf + 20 * m[doc])
            lists = Lists(len(ids), doc, terms.flatten().to_numpy(), parts)
            for own, mine in zip(best, item_terms, strict=True):
                totals = lists.scores(mine, weights[mine], k, own.least)
                some = np.flatnonzero(totals >= max(own.least, _kth(totals, k), 1))
                if len(some):
                    own.add(totals[some], ids[some], unnamed[some])
        item = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        if len(item):
            ids, unnamed, scores = (np.concatenate([getattr(b, x) for b in best]) for x in ("ids", "unnamed", "scores"))
            yield pa.RecordBatch.from_arrays([item_ids.take(pa.array(item)), pa.array(ids, pa.int64(), mask=unnamed), pa.array(scores, pa.int64())], names=schema.names)

    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Of each item the k documents of highest score above 0: ``item_id``, ``rank`` (int, from 1), ``doc_id`` (long), ``score`` (long).

    An item is all rows of one ``item_id``, the null one too; its terms count once.
    A document is a row: rows that share an id, or all columns, are ranked each by
    itself. Equal scores are in ascending order of id, documents without an id
    last. Null and empty texts have no terms. Without documents, items or common
    terms there are no rows. Other columns are not looked at.

    Items go to the tasks in blocks of about ``block_terms`` terms, or one item.
    For each block the documents are read once, and their postings of the block's
    terms written; these are read to count documents of each term, and to search.
    A task passes on k documents of an item, and at most ``MERGED`` tasks' are
    merged in one place.
    """
    spark, kind = docs.sparkSession, items.schema[item_id].dataType
    named = items.select(items[f"`{item_id}`"].alias("item_id"), F.explode(terms_of(items[f"`{text}`"])).alias("term")).distinct()
    named = stage(named, "item-terms")
    blocks = max(1, -(-named.count() // block_terms))
    found = []
    for block in range(blocks):
        some = named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        names = some.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        words = some.column("term").combine_chunks().dictionary_encode()
        if not len(names):
            continue
        terms = words.dictionary.to_pylist()
        rows = stage(postings(docs, terms, doc_id=doc_id, text=text), "postings")
        counts = rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("total")).first()
        if not counts["n"]:
            continue
        df = np.zeros(len(terms), np.int64)
        for row in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * counts["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        item, term = names.indices.to_numpy(), words.indices.to_numpy()
        term, item = (x[np.lexsort((term, df[term], item))] for x in (term, item))  # within an item the rarest first
        cuts = np.searchsorted(item, np.arange(1, len(names.dictionary)))
        best = _searched(rows, names.dictionary, np.split(term, cuts), weights, counts["n"], counts["total"], k, kind)
        merged = _ranked(best.withColumn("at", F.expr(f"spark_partition_id() div {MERGED}")), ["item_id", "at"], k)
        found.append(stage(_ranked(merged.drop("rank", "at"), ["item_id"], k).select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
