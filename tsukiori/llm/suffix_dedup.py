"""Removal of long byte strings that occur more than once, by a sparse suffix array.

Every window of ``window`` bytes belongs to an anchor (see ``anchors``). Equal
windows have equal bytes around their anchors, so instead of all suffixes only
those at anchors are sorted. Three sorts (see ``suffixes``) decide all windows:

1. Anchors. If what all windows of an anchor span together is repeated, all are;
   if the anchor's leading bytes are not, none is.
2. Blocks of the other anchors' windows, at offsets counted from the anchor. The
   same with what the windows of a block span together, and what they share.
3. The single windows of blocks that are still open.

Of repeated anchors or blocks, one goes on to the next sort, if there are open
ones that it may settle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.llm import anchors, suffixes
from tsukiori.llm import textbytes as tb
from tsukiori.scratch import stage

#: Bytes of a string that is removed if it occurs again.
WINDOW = 200
#: Leading bytes by which anchors are chosen and first compared.
LEAD = 64
#: Windows of a block.
BLOCK = 16

_U = np.uint64

Rows = tuple[np.ndarray, list[np.ndarray]]


def _place(first: np.ndarray, more: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """First window, number of further ones and distance of the anchor, in one number."""
    return first << 24 | more << 12 | anchor


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, place >> 12 & 0xFFF, place & 0xFFF


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as numbers in the order of the bytes."""
    word = np.zeros(len(at), _U)
    for k in range(8):
        word = word << _U(8) | data[at + k].astype(_U)
    return (word ^ _U(1 << 63)).view(np.int64)


class Hashes:
    """Hashes of any substrings of one batch."""

    def __init__(self) -> None:
        self.rolling = tb.Rolling(20), tb.Rolling(21)

    def read(self, data: np.ndarray) -> Hashes:
        self.data = data
        self.sums = [r.prefix(data) for r in self.rolling]
        return self

    def of(self, which: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.rolling[which].between(self.sums[which], first, last)


def _shape(hashes: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return tb.mix(hashes + (one << 32 | other).astype(_U)).view(np.int64)


def _of_anchors(h: Hashes, offsets: np.ndarray, window: int) -> Rows:
    found = anchors.find(h.rolling[0], h.sums[0], offsets, window, min(LEAD, window))
    at, first, last = found.at, found.first, found.last
    doc = np.searchsorted(offsets, first, "right") - 1
    key = h.of(0, at, at + min(LEAD, window)).view(np.int64)
    rest = _shape(h.of(1, first, last + window), at - first, last - first)
    return doc, [_lead(h.data, at), key, rest, _place(first - offsets[doc], last - first, at - first)]


def _of_blocks(h: Hashes, offsets: np.ndarray, window: int, doc: np.ndarray, place: np.ndarray) -> Rows:
    first, more, anchor = _unpack(place)
    at = first + anchor + offsets[doc]
    least, most = anchor - more, anchor  # distances of the windows from their anchor
    count = most // BLOCK - least // BLOCK + 1
    unit = np.repeat(np.arange(len(doc)), count)
    block = least[unit] // BLOCK + np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    near = np.maximum(least[unit], block * BLOCK)
    far = np.minimum(most[unit], block * BLOCK + BLOCK - 1)
    core = at[unit] - block * BLOCK
    key = h.of(0, core, core - BLOCK + 1 + window).view(np.int64)
    rest = _shape(h.of(1, at[unit] - far, at[unit] - near + window), far - block * BLOCK, far - near)
    doc = doc[unit]
    return doc, [_lead(h.data, core), key, rest, _place(at[unit] - far - offsets[doc], far - near, np.zeros(len(unit), np.int64))]


def _of_windows(h: Hashes, offsets: np.ndarray, window: int, doc: np.ndarray, place: np.ndarray) -> Rows:
    first, more, _ = _unpack(place)
    unit = np.repeat(np.arange(len(doc)), more + 1)
    at = first[unit] + np.arange(len(unit)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    doc = doc[unit]
    start = at + offsets[doc]
    key, rest = (h.of(k, start, start + window).view(np.int64) for k in (0, 1))
    return doc, [_lead(h.data, start), key, rest, _place(at, np.zeros_like(at), np.zeros_like(at))]


def _flat_lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The list that each value is of, and the values. A null list is empty."""
    counts = np.array(values.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(values)), counts), values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _suffixes(docs: DataFrame, make: Callable[[Hashes, np.ndarray, pa.RecordBatch], Rows]) -> DataFrame:
    """The suffixes that a function makes of each batch of ``id, copy, text, ...``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for start, stop in tb.slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                data, offsets = tb.utf8(part.column(2))
                doc, (lead, key, rest, place) = make(hashes.read(data), offsets, part)
                owner = [part.column(k).take(pa.array(doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead), pa.array(key), pa.array(rest), *owner, pa.array(place, pa.int64())],
                    names=[*suffixes.WORDS, *suffixes.OWNER],
                )

    return docs.mapInArrow(run, suffixes.SCHEMA)


def _by_document(rows: DataFrame, **states: tuple[int, ...]) -> DataFrame:
    """The places of each document by state, as arrays; null where there are none.

    A document is known by its id and a hash of its text.
    """
    places = {name: F.collect_set(F.when(F.col("state").isin(*own), F.col("place"))) for name, own in states.items()}
    found = rows.groupBy(F.col("id").alias("__id"), F.col("copy").alias("__copy")).agg(*[c.alias(n) for n, c in places.items()])
    return found.select("__id", "__copy", *[F.when(F.size(name) > 0, F.col(name)).alias(name) for name in states])


def _with(docs: DataFrame, places: DataFrame, how: str = "left") -> DataFrame:
    same = docs["id"].eqNullSafe(places["__id"]) & (docs["copy"] == places["__copy"])
    return docs.join(places, same, how).drop("__id", "__copy")


def _make_digest(window: int) -> Callable[[], tb.Work]:
    """What is removed of each text: covered by the given places."""

    def make() -> tb.Work:
        def work(data: np.ndarray, offsets: np.ndarray, *places: pa.Array) -> list[pa.Array]:
            change = np.zeros(len(data) + 1, np.int64)
            for column in places:
                doc, place = _flat_lists(column)
                first, more, _ = _unpack(place)
                start = first + offsets[doc]
                np.add.at(change, start, 1)
                np.add.at(change, start + more + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            starts, ends = tb.runs(gone, offsets)
            bounds = tb.owners(starts, offsets)
            base = np.repeat(offsets[:-1], np.diff(bounds))
            spans = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"])
            left = np.concatenate([[0], np.cumsum(~gone)])
            kept, cut = data[~gone].tobytes(), left[offsets]
            return [
                pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
                pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
            ]

        return work

    return make


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_DIGEST = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", _SPANS), T.StructField("kept_sha256", T.StringType())]


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document, the bytes covered by ``window``-byte strings that occur elsewhere too.

    Texts are UTF-8 bytes, null ones empty. A string counts as repeated if it
    starts anywhere else, in the same document or another; overlaps count; no
    string crosses two documents. Returns ``id_col``, ``n_bytes`` (long),
    ``spans`` (array of struct of start, end: the maximal covered runs, in bytes,
    ascending) and ``kept_sha256`` (of the other bytes, concatenated).
    ``without_spans`` gives the texts without them.

    Strings are compared by 128 bits of hashes. Rows of one id and one text are
    copies, of which each is repeated, wholly if it has ``window`` bytes; ids may
    be null or shared. Without documents there are no rows. Other columns are not
    looked at. ``window`` is from 32 to 2048.

    Besides the sorts of suffixes, all texts are shuffled once, to meet the
    places found, and those with open windows twice more.
    """
    if not 32 <= window <= 2048:
        raise ValueError("windows from 32 to 2048 bytes")
    own = docs[f"`{text}`"].cast("string")
    source = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(own).alias("copy"), own.alias("text"))
    flagged = suffixes.repeated(_suffixes(source, lambda h, offsets, _: _of_anchors(h, offsets, window)), "anchors")
    met = _with(source, _by_document(flagged, whole=(2, 3), open=(1, 3)))
    met = met.withColumn("left", F.when(F.col("open").isNotNull(), F.col("text")))
    digest = _make_digest(window)
    first = stage(tb.per_document(met, "text", ["id", "copy", "left", "open", "whole"], _DIGEST, digest, ["whole"]), "spans")
    done = first.where("open IS NULL").select("id", "n_bytes", "spans", "kept_sha256")
    rest = first.where("open IS NOT NULL").select("id", "copy", F.col("left").alias("text"), "open", "whole")

    def of_blocks(h: Hashes, offsets: np.ndarray, part: pa.RecordBatch) -> Rows:
        return _of_blocks(h, offsets, window, *_flat_lists(part.column(3)))

    def of_windows(h: Hashes, offsets: np.ndarray, part: pa.RecordBatch) -> Rows:
        return _of_windows(h, offsets, window, *_flat_lists(part.column(3)))

    blocks = suffixes.repeated(_suffixes(rest, of_blocks), "blocks")
    undecided = _with(rest.select("id", "copy", "text"), _by_document(blocks, open=(1, 3)).where("open IS NOT NULL"), "inner")
    windows = suffixes.repeated(_suffixes(undecided, of_windows), "windows")
    more = _by_document(blocks.unionByName(windows), more=(2, 3))
    last = tb.per_document(_with(rest, more), "text", ["id"], _DIGEST, digest, ["whole", "more"])
    return done.unionByName(last).withColumnRenamed("id", id_col)


def without_spans(docs: DataFrame, *, text: str = "text", spans: str = "spans", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``kept`` (binary): each text's bytes outside its spans."""

    def make() -> tb.Work:
        def work(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> list[pa.Array]:
            doc = np.repeat(np.arange(len(column)), np.array(column.value_lengths().fill_null(0)))
            flat = column.flatten()
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, flat.field("start").to_numpy() + offsets[doc], 1)
            np.add.at(change, flat.field("end").to_numpy() + offsets[doc], -1)
            stays = np.cumsum(change[:-1]) == 0
            cut = np.concatenate([[0], np.cumsum(stays)])[offsets].astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(cut), pa.py_buffer(data[stays].tobytes())])
            return [kept]

        return work

    return tb.per_document(docs, text, keep, [T.StructField("kept", T.BinaryType())], make, [spans])
