"""Byte-level BPE encoding and decoding in higher-order functions.

The frequent words of a table are encoded first, each once. Then documents are
taken in batches, each one row: its distinct words still to be encoded, and its
documents as runs of ids with numbers of these words between them, so that an
expression is evaluated for each run and not for each word. A word is written in hexadecimal, and
its pieces are an array of where each starts, at first its bytes. A fold over the array
merges, each time, the leftmost of the adjacent pairs whose concatenation has the lowest
rank, by taking out the second one's start, until no pair has one.
The ranks are the value of a scalar subquery: an array of small maps, of which a
piece's hash selects one. Decoding takes the pieces of the ids from an array, in the
same way, and concatenates their bytes. As literals they would be written out in each plan's
description, which the driver makes, logs and keeps for every query.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.llm import textbytes as tb
from tsukiori.llm.pretokens import split
from tsukiori.scratch import stage

#: Maps that the ranks are spread over.
BUCKETS = 1 << 14
#: Words, at most, that are encoded before, and how many of them a task folds.
MOST, FOLDED = 1 << 20, 20_000
#: Bytes of text of a batch, if a single text is not longer.
BATCH_BYTES = 1 << 20
#: Bytes of the longest word that is folded.
LONG = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces of a rank file: a base64 text and a rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def _bucket(piece: Column, buckets: int) -> Column:
    return F.pmod(F.hash(piece), F.lit(buckets))


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """An array of maps from pieces, in hexadecimal, to ranks."""
    rows = [(piece.hex().upper(), rank) for piece, rank in ranks.items()]
    placed = spark.createDataFrame(rows, "piece string, rank int").select("*", _bucket(F.col("piece"), BUCKETS).alias("at"))
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for row in placed.toLocalIterator():
        buckets[row["at"]][row["piece"]] = row["rank"]
    return _value(spark, buckets, "array<map<string,int>>")


def piece_array(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """Pieces by rank; null where no piece has it. Their bytes have the type of a text, to be joined as they are."""
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return _value(spark, pieces, "array<binary>", "array<string>")


def _value(spark: SparkSession, value: list, kind: str, cast: str | None = None) -> Column:
    """The value, which a plan names but does not spell; for a column, as functions with lambdas take no subquery."""
    made = spark.createDataFrame([(value,)], f"value {kind}").coalesce(1)
    return (made.select(made["value"].cast(cast)) if cast else made).scalar()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: the end of a fold over nothing.

    An element of a transformed array would do too, but taking one out asks for its
    type each time, which is found by going through all of the expression.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, use)


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word, in hexadecimal: its own rank, or those of its merged pieces."""

    def rank_of(piece: Column) -> Column:
        return F.try_element_at(F.get(ranks, _bucket(piece, BUCKETS)), piece)

    def merged(own: Column) -> Column:
        end = F.length(own) + 1

        def piece(starts: Column, at: Column, count: int, start: Column) -> Column:  # null where fewer follow
            return F.substring(own, start, F.get(starts, at + count) - start)

        def merge(starts: Column, _: Column) -> Column:
            pairs = F.transform(F.transform(starts, lambda start, i: piece(starts, i, 2, start)), rank_of)
            lowest = _let(pairs, lambda found: F.array_position(found, F.array_min(found)).cast("int"))  # null where no pair has a rank
            both = _let(lowest, lambda at: F.when(at > 0, F.array_remove(starts, F.get(starts, at))).otherwise(F.array_append(starts, F.lit(0))))
            return F.when(F.element_at(starts, -1) == 0, starts).otherwise(both)  # a zero marks the end

        def ids(starts: Column) -> Column:
            first = F.filter(starts, lambda start: (start > 0) & (start < end))
            return F.transform(F.transform(first, lambda start, i: piece(starts, i, 1, start)), rank_of)

        bounds = _let(F.sequence(F.lit(1), end, F.lit(2)), lambda singles: F.aggregate(singles, singles, merge))
        return _let(bounds, ids)

    return _let(word, lambda own: F.coalesce(_let(rank_of(own), lambda r: F.when(r.isNotNull(), F.array(r))), merged(own)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word, by a heap of its pairs: time grows with its length, not the square."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size - 1))  # of the piece that starts there
    heap = [(rank, i, i + 1, i + 2) for i in range(size - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or end[middle] != stop:  # one of the two is in another piece by now
            continue
        end[start], end[middle] = stop, 0
        if stop < size:
            before[stop] = start
            if (rank := ranks.get(word[start : end[stop]])) is not None:
                heapq.heappush(heap, (rank, start, stop, end[stop]))
        if start:
            left = before[start]
            if (rank := ranks.get(word[left:stop])) is not None:
                heapq.heappush(heap, (rank, left, start, stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of hashes is first, and the number of each one's pair."""
    same = pa.array(first).dictionary_encode().indices.to_numpy()
    at = np.zeros(int(same.max(initial=-1)) + 1, np.int64)
    at[same[::-1]] = np.arange(len(same))[::-1]  # the last one written is the first one there
    if (second[at[same]] != second).any():  # two words of one first hash
        _, at, same = np.unique(np.stack([first, second]), axis=1, return_index=True, return_inverse=True)
    return at, same.ravel()


class _Words:
    """The words of some texts, and which of them are distinct."""

    def __init__(self, rolling: tuple[tb.Rolling, tb.Rolling], texts: pa.Array):
        self.data, self.offsets = tb.utf8(texts)
        self.starts = split(self.data, self.offsets)
        self.ends = np.append(self.starts[1:], len(self.data))[: len(self.starts)]
        hashes = np.stack([r.between(r.prefix(self.data), self.starts, self.ends) for r in rolling])
        self.first, self.number = _distinct(*hashes)
        self.hashes, self.lengths = hashes[:, self.first], (self.ends - self.starts)[self.first]

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The given ones of the distinct words."""
        whole, at = self.data.tobytes(), self.first[which]
        return [whole[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Known:
    """The ids of words that are encoded already, by two 64-bit hashes of the word."""

    def __init__(self, packed: Iterable[tuple[bytes, bytes, bytes]] = ()):
        """Of some words at a time, what ``pack`` makes of them."""
        parts = [(np.frombuffer(h, np.uint64).reshape(2, -1), np.frombuffer(n, np.int32), np.frombuffer(v, np.int32)) for h, n, v in packed]
        hashes = np.concatenate([np.zeros((2, 0), np.uint64), *(x[0] for x in parts)], axis=1)
        counts, self.values = (np.concatenate([np.zeros(0, np.int32), *(x[i] for x in parts)]) for i in (1, 2))
        self.order = np.argsort(hashes[0]).astype(np.int32)
        self.hashes = hashes[:, self.order]
        self.bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @staticmethod
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes, numbers of ids, and ids of each batch of words, as bytes."""
        rolling = tb.Rolling(8), tb.Rolling(9)
        for batch in batches:
            data, offsets = tb.flat(batch.column(0))
            hashes = np.stack([r.between(r.prefix(data), offsets[:-1], offsets[1:]) for r in rolling])
            arrays = hashes, batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["hashes", "counts", "ids"])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for an unknown one."""
        if not len(self.order):
            return np.full(hashes.shape[1], -1)
        at = np.minimum(np.searchsorted(self.hashes[0], hashes[0]), len(self.order) - 1)
        return np.where((self.hashes[:, at] == hashes).all(axis=0), self.order[at], -1)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at some places in turn, and how many each has; none at -1."""
        counts = np.where(places < 0, 0, self.bounds[places + 1] - self.bounds[places])
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.values[np.repeat(self.bounds[places], counts) + within], counts


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word`` (binary) and ``n`` of the words of the table that are not long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = tb.Rolling(8), tb.Rolling(9)
        for batch in batches:
            for start, stop in tb.slices(batch.column(0), BATCH_BYTES):
                words = _Words(rolling, batch.column(0).slice(start, stop - start))
                short = np.flatnonzero(words.lengths <= LONG)
                counts = np.bincount(words.number, minlength=len(words.first))[short]
                yield pa.RecordBatch.from_arrays([pa.array(words.spelled(short), pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

    rows = docs.select(docs[f"`{text}`"].cast("string")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _known(docs: DataFrame, text: str, ranks: Column) -> Known:
    """The most frequent words of the table, ``MOST`` at most, each of them encoded once.

    They are those of a number of occurrences from which on there are no more;
    numbers are compared by eighths of their binary logarithm.
    """
    counts = stage(_word_counts(docs, text).where(F.col("n") >= 2).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "words")
    levels, total, least = counts.groupBy("level").count().orderBy(F.desc("level")).collect(), 0, None
    for row in levels:
        if total + row["count"] > MOST:
            break
        total, least = total + row["count"], row["level"]
    if least is None:
        return Known()
    # Dealt by a job of its own: the plan that holds the ranks then has no exchange, and is made and described once.
    chosen = stage(counts.where(F.col("level") >= least).select("word").repartition(-(-total // FOLDED), F.xxhash64("word")), "frequent-words")
    made = chosen.select("word", ranks.alias("__ranks")).select("word", _let(F.col("__ranks"), lambda own: encode_word(F.hex("word"), own)).alias("ids"))
    return Known(made.mapInArrow(Known.pack, "hashes binary, counts binary, ids binary").collect())


def _batches(docs: DataFrame, keep: list[str], text: str, known: Known, ranks: dict[bytes, int]) -> DataFrame:
    """A row per batch: its distinct words that are not long and not known, and the parts of each document.

    A word is in hexadecimal. A part is the ids of known and long words in turn, or the number of one of the words.
    """
    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    part_kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("number", T.IntegerType())])
    kind = T.StructType([*fields, T.StructField("parts", T.ArrayType(part_kind))])
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("docs", T.ArrayType(kind))])
    count = len(keep)
    sent = docs.sparkSession.sparkContext.broadcast((known, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = tb.Rolling(8), tb.Rolling(9)
        known, ranks = sent.value
        for batch in batches:
            for start, stop in tb.slices(batch.column(count), BATCH_BYTES):
                rows = batch.slice(start, stop - start)
                words = _Words(rolling, rows.column(count))
                places = known.find(words.hashes)
                values, counts = known.ids(places)
                long = np.flatnonzero(words.lengths > LONG)
                merged = [merge_long(w, ranks) for w in words.spelled(long)]
                if len(long):
                    before = np.concatenate([[0], np.cumsum(counts)])[long]
                    sizes = [len(ids) for ids in merged]
                    values = np.insert(values, np.repeat(before, sizes), [i for ids in merged for i in ids])
                    counts[long] = sizes
                new = (places < 0) & (words.lengths <= LONG)
                spelled = pa.array([w.hex().upper() for w in words.spelled(np.flatnonzero(new))], pa.string())
                docs_at = tb.owners(words.starts, words.offsets)
                parts, parts_at = _parts(words.number, docs_at, new, values, counts)
                lists = pa.ListArray.from_arrays(pa.array(parts_at, pa.int32()), parts)
                made = pa.StructArray.from_arrays([*rows.columns[:count], lists], names=[*keep, "parts"])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (spelled, made)], names=["words", "docs"]
                )

    return docs.select(*[f"`{c}`" for c in keep], docs[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, schema)


def _parts(number: np.ndarray, docs_at: np.ndarray, new: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of some documents, and where each document's start among them.

    Given are the number of each word in turn, where the documents start, and of
    each number if the word is new, and the ids of the others in turn with how
    many each has.
    """
    open_word = new[number]
    cut = open_word.copy()  # a part starts here
    cut[1:] |= open_word[:-1]
    cut[docs_at[:-1][np.diff(docs_at) > 0]] = True
    first = np.flatnonzero(cut)
    sizes = counts[number]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    from_ = (np.cumsum(counts) - counts)[number]
    ids = values[np.repeat(from_ - ends[:-1], sizes) + np.arange(ends[-1])]
    unknown = open_word[first]
    bounds = pa.array(np.append(ends[first], ends[-1]), pa.int32())
    lists = pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()), mask=pa.array(unknown))
    numbers = pa.array((np.cumsum(new) - 1)[number[first]], pa.int32(), mask=~unknown)
    return pa.StructArray.from_arrays([lists, numbers], names=["ids", "number"]), np.searchsorted(first, docs_at)


def encode(docs: DataFrame, ranks: dict[bytes, int], *, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns of each document, and ``ids`` (array of int): its text in tokens.

    A text is split as the byte-level vocabularies ask for (see ``pretokens``),
    and each word is encoded by itself: by its rank, if it has one, else by
    merging its bytes as described above. Every single byte must have a rank.

    The words of the table are counted, and the ``MOST`` most frequent of them
    encoded first, once; they go to all tasks. Others, which are rare, are encoded
    once in each batch of ``BATCH_BYTES``, or one longer text, that has them. What
    is shuffled is counts of words. Words of more than ``LONG`` bytes are merged
    by a heap in Python, because a fold takes the square of their length.

    Null and empty texts have no ids. Repeated documents each get their row.
    Other columns are not looked at, and a kept one named ``ids`` is replaced.
    """
    keep = [name for name in dict.fromkeys(keep) if name.lower() != "ids"]
    placed = rank_map(docs.sparkSession, ranks)
    known = _known(docs, text, placed)

    def of_batch(coded: Column) -> Column:
        def of_document(doc: Column) -> Column:
            ids = F.flatten(F.transform(doc["parts"], lambda part: F.coalesce(part["ids"], F.get(coded, part["number"]))))
            return F.struct(*[doc[name].alias(name) for name in keep], ids.alias("ids"))

        return F.transform("docs", of_document)

    def coded(own: Column) -> Column:  # the ranks are bound, so that a plan holds them once
        return F.transform("words", lambda word: encode_word(word, own))

    rows = _batches(docs, keep, text, known, ranks).select("words", "docs", placed.alias("__ranks"))
    return rows.select(F.inline(_let(_let(F.col("__ranks"), coded), of_batch)))


def decode(tokens: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, and ``decoded`` (binary): the pieces of the ids, concatenated.

    Null ids give null; an id that no piece has adds nothing. A kept column
    named ``decoded`` is replaced. No shuffle.
    """
    keep = [name for name in dict.fromkeys(keep) if name.lower() != "decoded"]
    placed = piece_array(tokens.sparkSession, ranks)
    rows = tokens.select(*[f"`{c}`" for c in keep], tokens[f"`{ids}`"].alias("__ids"), placed.alias("__pieces"))
    text = _let(F.col("__pieces"), lambda pieces: F.array_join(F.transform("__ids", lambda i: F.get(pieces, i)), ""))
    return rows.select(*[f"`{c}`" for c in keep], text.cast("binary").alias("decoded"))
