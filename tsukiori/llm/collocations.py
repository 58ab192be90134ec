"""Phrases that occur more often than their parts suggest, by marginalising the longest windows.

At each word a window opens: its word and the next ones of the same piece, as
lead columns, padded with nulls where the piece ends. Only these longest windows
are counted. A ROLLUP over the columns sums their counts to those of successively
shorter prefixes, so each phrase, of any length, is counted as the prefix of the
windows that begin with it.

A phrase that is frequent enough has no rarer word and no rarer pair of
neighbours. So a window is padded already from the first rare word or pair on;
both are counted before, and go to the tasks as bits of their hashes, whose
number is bounded. A bit set by chance only makes a window longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsukiori.llm import textbytes as tb
from tsukiori.scratch import stage

#: Words of the longest phrase.
LONGEST = 5
#: Binary digits of the number of bits sent to the tasks: least and most (16 MB); between, 16 bits for a hash.
FILTER = (16, 27)
#: The language of documents without one.
UNKNOWN = "und"
#: Bytes of text worked on at a time.
SLICE = 4 << 20

_BREAK = tb.byte_table(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
_WORD = tb.byte_table(lambda b: b not in b" \t") & ~_BREAK
_U = np.uint64


class Filter:
    """A set of 64-bit hashes, and some more by chance."""

    def __init__(self, packed: np.ndarray, digits: int):
        self.packed, self.digits = packed, digits

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> _U(64 - self.digits)
        return (self.packed[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8) & 1).astype(bool)


def _filter(keys: DataFrame) -> Filter:
    """The set of the keys (long), written once; its bits are put together in tasks, 2**16 in each."""
    least, most = FILTER
    keys = stage(keys, "keys")
    digits = min(max((16 * keys.count()).bit_length(), least), most)
    places = keys.select(F.shiftrightunsigned("key", 64 - digits).alias("place")).distinct()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << least, np.uint8)
        bits[rows["place"].to_numpy() & ((1 << least) - 1)] = 1
        return pd.DataFrame({"segment": [int(rows["segment"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    segments = places.withColumn("segment", F.shiftright("place", least)).groupBy("segment").applyInPandas(pack, "segment long, bits binary")
    packed = np.zeros(1 << digits >> 3, np.uint8)
    for row in segments.collect():
        packed[row["segment"] << (least - 3) :][: 1 << (least - 3)] = np.frombuffer(row["bits"], np.uint8)
    return Filter(packed, digits)


class Words:
    """The words of some texts: places, a key of word and language, and whether the next word is of the same piece."""

    def __init__(self, rolling: tb.Rolling, texts: pa.Array, langs: pa.Array):
        data, offsets = tb.utf8(texts)
        data = tb.LOWER[data]
        self.data, (self.starts, self.ends) = data, tb.runs(_WORD[data], offsets)
        self.names = langs.dictionary_encode()
        named, places = tb.flat(self.names.dictionary)
        salt = rolling.between(rolling.prefix(named), places[:-1], places[1:])
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(tb.owners(self.starts, offsets)))
        self.lang = self.names.indices.to_numpy()[doc]
        own = rolling.between(rolling.prefix(data), self.starts, self.ends)
        self.keys = tb.mix(own + salt[self.lang] * _U(0x9E3779B97F4A7C15))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        self.joined = np.zeros(len(self.starts), bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])


def _pairs(keys: np.ndarray) -> np.ndarray:
    return tb.mix(keys[:-1] * _U(0xD1342543DE82EF95) + keys[1:])


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64), pa.int64())


def _scan(docs: DataFrame, schema: str, work: Callable[[Words], list[pa.Array]], names: list[str]) -> DataFrame:
    """What the work makes of the words of a few documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = tb.Rolling(8)
        for batch in batches:
            for start, stop in tb.slices(batch.column(0), SLICE):
                part = batch.slice(start, stop - start)
                made = work(Words(rolling, part.column(0), part.column(1)))
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays(made, names=names)

    return docs.mapInArrow(run, schema)


def _word_counts(docs: DataFrame) -> DataFrame:
    """``key``, ``lang``, ``word`` and ``n`` of each word of each language."""

    def work(words: Words) -> list[pa.Array]:
        keys, at, counts = np.unique(words.keys, return_index=True, return_counts=True)
        whole = words.data.tobytes()
        texts = [whole[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
        langs = words.names.dictionary.take(pa.array(words.lang[at]))
        return [_signed(keys), langs, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]

    rows = _scan(docs, "key long, lang string, word string, n long", work, ["key", "lang", "word", "n"])
    return rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _pair_counts(docs: DataFrame, known: Filter) -> DataFrame:
    """``key`` and ``n`` of each pair of neighbours both of which are known."""

    def work(words: Words) -> list[pa.Array]:
        frequent = known.has(words.keys)
        both = words.joined[:-1] & frequent[:-1] & frequent[1:]
        keys, counts = np.unique(_pairs(words.keys)[both], return_counts=True)
        return [_signed(keys), pa.array(counts, pa.int64())]

    return _scan(docs, "key long, n long", work, ["key", "n"]).groupBy("key").agg(F.sum("n").alias("n"))


def _windows(docs: DataFrame, known: Filter, pairs: Filter, longest: int) -> DataFrame:
    """``w1`` ... and ``n``: the windows of two words and more, and how often each occurs."""
    columns = [f"w{i + 1}" for i in range(longest)]

    def work(words: Words) -> list[pa.Array]:
        count = len(words.keys)
        frequent, next_ = known.has(words.keys), np.zeros(count, bool)
        if count:
            next_[:-1] = words.joined[:-1] & frequent[:-1] & frequent[1:] & pairs.has(_pairs(words.keys))
        at = np.flatnonzero(next_)
        lead, inside = np.zeros((longest, len(at)), _U), np.zeros((longest, len(at)), bool)
        lead[0], inside[0], going = words.keys[at], True, np.ones(len(at), bool)
        for k in range(1, longest):
            going = going & next_[np.minimum(at + k - 1, count - 1)]
            inside[k], lead[k] = going, np.where(going, words.keys[np.minimum(at + k, count - 1)], 0)
        whole = np.zeros(len(at), _U)
        for k in range(longest):
            whole = tb.mix(whole * _U(0xD1342543DE82EF95) + lead[k] + inside[k])
        _, first, counts = np.unique(whole, return_index=True, return_counts=True)
        made = [pa.array(lead[k, first].view(np.int64), pa.int64(), mask=~inside[k, first]) for k in range(longest)]
        return [*made, pa.array(counts, pa.int64())]

    rows = _scan(docs, ", ".join(f"{c} long" for c in [*columns, "n"]), work, [*columns, "n"])
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


def _frequent_phrases(windows: DataFrame, least: int, longest: int) -> DataFrame:
    """``words`` (array of keys) and ``a``: the phrases that occur often enough, from the sums over prefixes."""
    columns = [f"w{i + 1}" for i in range(longest)]
    summed = windows.rollup(*columns).agg(F.sum("n").alias("a"), F.grouping_id().alias("rolled"))
    size = F.lit(longest) - F.round(F.log2(F.col("rolled") + 1)).cast("int")
    words = F.slice(F.array(*columns), F.lit(1), F.greatest(size, F.lit(1)))
    rows = summed.where(F.col("a") >= least).select(words.alias("words"), "a", size.alias("size"))
    return rows.where((F.col("size") >= 2) & F.element_at("words", -1).isNotNull()).select("words", "a")



def collocations(
    docs: DataFrame, *, least: int = 100, top: int = 2000, longest: int = LONGEST, percent: int = 100, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, numbers long.

    Texts, A-Z in lower case, are cut into pieces at ``.,;:!?`` and line ends, and
    these into words at blanks and tabs. A candidate is a phrase of 2 to
    ``longest`` words of one piece that occurs ``a >= least`` times in its
    language, overlaps included. Cut in two, its parts occur l and r times, and
    with n words in all its score is ``1000 a n / (l r)``, rounded down; of its cuts
    the one of least score counts, the earliest of several. A candidate goes if it
    lies inside a longer one that occurs ``percent`` hundredths as often or more. The others
    are ranked by score, then a, both descending, then by phrase.

    Null texts are empty; a null language is ``und``, together with documents that
    say so. Repeated documents count each time. Without candidates there are no
    rows. Other columns are not looked at. Words are known by a 64-bit hash of
    word and language.

    Texts are read three times, and never shuffled: what a task has counted is.
    """
    source = docs.select(docs[f"`{text}`"].cast("string").alias("text"), F.coalesce(docs[f"`{lang}`"].cast("string"), F.lit(UNKNOWN)).alias("lang"))
    words = stage(_word_counts(source), "words")
    frequent = words.where(F.col("n") >= least)
    known = _filter(frequent.select("key"))
    pairs = _filter(_pair_counts(source, known).where(F.col("n") >= least).select("key"))
    phrases = stage(_frequent_phrases(_windows(source, known, pairs, longest), least, longest), "phrases")

    spelled = phrases.select("words", F.posexplode("words").alias("at", "key")).join(frequent.select("key", "lang", "word"), "key")
    spelled = spelled.groupBy("words").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.min("lang").alias("lang"),
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    parts = phrases.union(frequent.select(F.array("key"), "n"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("before"), F.slice("words", F.col("k") + 1, F.size("words")).alias("after"))
    cuts = cuts.join(parts.select(F.col("words").alias("before"), F.col("a").alias("l")), "before")
    cuts = cuts.join(parts.select(F.col("words").alias("after"), F.col("a").alias("r")), "after")
    cuts = cuts.join(spelled, "words").join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("words", "a", "lang", "phrase", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.slice("words", at, size)),
        )
    )
    covered = phrases.where(F.size("words") > 2).select(F.explode(inner).alias("words"), F.col("a").alias("outer"))
    covered = covered.groupBy("words").agg(F.max("outer").alias("outer"))
    left = scored.join(covered, "words", "left").where(F.col("outer").isNull() | (100 * F.col("outer") < percent * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    first = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
