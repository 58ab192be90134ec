"""Benchmark decontamination: which words of which documents occur in test items.

Wu and Manber's search for many patterns, over words instead of bytes: a table
over blocks of two words says how far the window may move, a block of shift zero
leads to the bucket of the patterns that end with it, and these are compared
with the text, at last byte by byte. The windows of a batch move together, in
lanes, so that each step is one array operation.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsukiori.llm import textbytes as tb

#: Consecutive words of a test item that make up one pattern.
WINDOW = 10
#: Test texts in one set of tables, in bytes; a larger benchmark is searched in several.
BLOCK_BYTES = 64 << 20
#: Window ends that one lane walks over.
LANE = 512

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HASH_BITS = 18


@dataclass
class Tables:
    """The patterns of one length."""

    length: int
    shift: np.ndarray  # by block hash
    bucket: np.ndarray  # by block hash: its patterns are order[bucket[h]:bucket[h + 1]]
    order: np.ndarray
    words: np.ndarray  # word numbers of each pattern
    item_start: np.ndarray  # items of pattern p: items[item_start[p]:item_start[p + 1]]
    items: np.ndarray


@dataclass
class Dictionary:
    """All words of the patterns; numbers count from 1, 0 is any other word."""

    hashes: np.ndarray  # ascending
    numbers: np.ndarray
    blob: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    names: list[str]
    tables: list[Tables]


def words_of(text: str | None) -> list[bytes]:
    """The words of a test item, lower-cased in A-Z."""
    return _WORD.findall((text or "").encode().translate(bytes(tb.LOWER)))


def build(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> Dictionary:
    """Tables for the windows of test items. Items of equal id are one item."""
    patterns: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    names: dict[str, int] = {}
    for name, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            patterns[tuple(words[at : at + window])].add(names.setdefault(name, len(names)))
    vocabulary = list(dict.fromkeys(w for p in patterns for w in p))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    blob = np.frombuffer(b"".join(vocabulary), np.uint8)
    lengths = np.array([0, *map(len, vocabulary)], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.int64)
    rolling = tb.Rolling(4)
    hashes = rolling.between(rolling.prefix(blob), starts[1:], starts[1:] + lengths[1:])
    order = np.argsort(hashes, kind="stable")
    by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
    for pattern in patterns:
        by_length[len(pattern)].append(pattern)
    tables = [
        _tables(length, np.array([[number[w] for w in p] for p in found], np.int64), [sorted(patterns[p]) for p in found])
        for length, found in sorted(by_length.items())
    ]
    return Dictionary(hashes[order], order + 1, blob, starts, lengths, list(names), tables)


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    code = (before.astype(np.uint64) << np.uint64(32)) | last.astype(np.uint64)
    return (tb.mix(code) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


def _tables(length: int, words: np.ndarray, items: list[list[int]]) -> Tables:
    size = min(2, length)
    shift = np.full(1 << _HASH_BITS, length - size + 1, np.int64)
    for end in range(size - 1, length):
        before = words[:, end - 1] if size == 2 else np.zeros(len(words), np.int64)
        np.minimum.at(shift, _block(before, words[:, end]), length - 1 - end)
    last = _block(words[:, -2] if size == 2 else np.zeros(len(words), np.int64), words[:, -1])
    order = np.argsort(last, kind="stable")
    counts = np.array([len(x) for x in items])
    return Tables(
        length, shift, np.searchsorted(last[order], np.arange((1 << _HASH_BITS) + 1)), order, words,
        np.concatenate([[0], np.cumsum(counts)]), np.array([i for x in items for i in x], np.int64),
    )


def numbers_of(known: Dictionary, rolling: tb.Rolling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The dictionary's number of each word of the text, by hash."""
    if not len(known.hashes) or not len(starts):
        return np.zeros(len(starts), np.int64)
    hashes = rolling.between(rolling.prefix(data), starts, ends)
    at = np.minimum(np.searchsorted(known.hashes, hashes), len(known.hashes) - 1)
    return np.where(known.hashes[at] == hashes, known.numbers[at], 0)


def _ends(tables: Tables, numbers: np.ndarray) -> np.ndarray:
    """Window ends that the shift table cannot rule out."""
    first, stop = tables.length - 1, len(numbers)
    position = np.arange(first, stop, LANE)
    limit = np.minimum(position + LANE, stop)
    found = []
    while len(position):
        before = numbers[position - 1] if tables.length > 1 else np.zeros(len(position), np.int64)
        shift = tables.shift[_block(before, numbers[position])]
        found.append(position[shift == 0])
        position = position + np.maximum(shift, 1)
        going = position < limit
        position, limit = position[going], limit[going]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(
    known: Dictionary, tables: Tables, numbers: np.ndarray, first_word: np.ndarray,
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Last words of the occurrences, and their patterns. ``first_word``: of each word's document."""
    at = _ends(tables, numbers)
    at = at[at - tables.length + 1 >= first_word[at]]
    if not len(at):
        return at, at
    before = numbers[at - 1] if tables.length > 1 else np.zeros(len(at), np.int64)
    block = _block(before, numbers[at])
    counts = tables.bucket[block + 1] - tables.bucket[block]
    pair_at = np.repeat(at, counts)
    within = np.arange(len(pair_at)) - np.repeat(np.cumsum(counts) - counts, counts)
    pattern = tables.order[np.repeat(tables.bucket[block], counts) + within]
    for back in range(tables.length):  # from the last word on, most pairs are gone soon
        same = numbers[pair_at - back] == tables.words[pattern, tables.length - 1 - back]
        pair_at, pattern = pair_at[same], pattern[same]
    word = (pair_at[:, None] - np.arange(tables.length)).ravel()
    word_number = numbers[word]
    fits = (ends[word] - starts[word]) == known.lengths[word_number]
    fits[fits] = tb.same_bytes(data, starts[word[fits]], known.blob, known.starts[word_number[fits]], known.lengths[word_number[fits]])
    whole = fits.reshape(-1, tables.length).all(axis=1)
    return pair_at[whole], pattern[whole]


def _make(known: Dictionary):
    def make():
        rolling = tb.Rolling(4)
        names = np.array(known.names, object)

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            data = tb.LOWER[data]
            starts, ends = tb.runs(tb.ALNUM[data], offsets)
            bounds = tb.owners(starts, offsets)
            n_words = np.diff(bounds)
            first_word = np.repeat(bounds[:-1], n_words)
            numbers = numbers_of(known, rolling, data, starts, ends)
            change = np.zeros(len(starts) + 1, np.int64)
            pairs = [np.zeros(0, np.int64)]
            for tables in known.tables:
                at, pattern = occurrences(known, tables, numbers, first_word, data, starts, ends)
                np.add.at(change, at - tables.length + 1, 1)
                np.add.at(change, at + 1, -1)
                counts = tables.item_start[pattern + 1] - tables.item_start[pattern]
                within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                item = tables.items[np.repeat(tables.item_start[pattern], counts) + within]
                doc = np.searchsorted(bounds, np.repeat(at, counts), "right") - 1
                pairs.append(doc * len(names) + item)
            hit = np.cumsum(change[:-1]) > 0
            hit_starts, hit_ends = tb.runs(hit, bounds)
            hit_bounds = tb.owners(hit_starts, bounds)
            base = np.repeat(bounds[:-1], np.diff(hit_bounds))
            ranges = np.stack([hit_starts - base, hit_ends - base], axis=1).ravel()
            pairs = np.unique(np.concatenate(pairs))
            doc = pairs // max(1, len(names))
            found = names[pairs % max(1, len(names))] if len(pairs) else []
            return [
                pa.array(n_words, pa.int64()),
                tb.lists(ranges, 2 * np.diff(hit_bounds), pa.int64()),
                tb.lists(found, np.bincount(doc, minlength=len(n_words)), pa.string()),
            ]

        return work

    return make


def find_test_items(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: Iterable[str] = ("doc_id",),
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The kept columns of each document, its words, and what of it occurs in test items.

    Words are runs of letters, digits and non-ASCII characters, lower-cased in
    A-Z. ``window`` consecutive words of an item are a pattern; an item of fewer
    words, but not none, is one. A document word inside any occurrence is hit.

    Adds ``n_words`` (long), ``hit_words`` (array of long: starts and ends of
    the runs of hit words, counted from 0, in turn), ``n_hit`` (long),
    ``item_ids`` (array of string, ascending: items with an occurring pattern)
    and ``contaminated`` (``n_hit > 0``).

    One pass over the documents without a shuffle, whatever their number. The
    test texts go to the tasks in blocks of at most ``block_bytes`` (or one
    item); each further block is a further column of the same pass.

    A null text has no words. Repeated documents each get their row. Items with
    a null id are named ``null``; items of one id count once; a null or empty
    item has no pattern. Without documents there are no rows, without items no
    hits. Other columns of either table are not looked at.
    """
    items = benchmark.select(
        F.coalesce(benchmark[f"`{item_id}`"].cast("string"), F.lit("null")).alias("name"),
        benchmark[f"`{item_text}`"].cast("string").alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("name"), F.lit(blocks))
    keep = list(dict.fromkeys(keep))
    found, made = docs.select(*[f"`{c}`" for c in keep], docs[f"`{text}`"].cast("string").alias("__text")), []
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    for block in range(blocks):
        known = build(items.where(part == block).toLocalIterator(), window)
        outputs = [T.StructField(f"__{field.name}{block}", field.dataType) for field in fields]
        found = tb.per_document(found, "__text", [*found.columns[: len(keep)], "__text", *made], outputs, _make(known))
        made += [field.name for field in outputs]
    ranges = F.col("__hits0") if blocks == 1 else _merged([F.col(f"__hits{b}") for b in range(blocks)])
    outputs = {
        "n_words": F.col("__n_words0"),
        "hit_words": ranges,
        "n_hit": F.aggregate(F.transform(ranges, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x),
        "item_ids": F.array_sort(F.array_distinct(F.concat(*[F.col(f"__items{b}") for b in range(blocks)]))),
        "contaminated": F.size(ranges) > 0,
    }
    kept = [name for name in keep if name.lower() not in outputs]
    return found.select(*[f"`{c}`" for c in kept], *[column.alias(name) for name, column in outputs.items()])


def _merged(parts):
    """Runs of hit words from several lists of runs: joined where they meet or overlap."""
    def pairs(runs):
        paired = F.transform(runs, lambda x, i: F.struct(x.alias("s"), F.get(runs, i + 1).alias("e")))
        return F.filter(paired, lambda _, i: i % 2 == 0)

    ordered = F.array_sort(F.concat(*[pairs(runs) for runs in parts]))

    def step(done, pair):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.greatest(last, pair["e"])))
        return F.when(last >= pair["s"], joined).otherwise(F.concat(done, F.array(pair["s"], pair["e"])))

    return F.aggregate(ordered, F.array().cast("array<bigint>"), step)
