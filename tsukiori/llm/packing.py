"""Packing documents into training sequences of several context sizes.

Documents are encoded once. Each gives as many full windows of the largest size
as it holds; what is left over is routed to the tier of the least size that holds
it. Small groups of documents, dealt by hash, are packed each by itself: from the
largest tier to the smallest, the longest text opens a window, and the gap behind
it is filled from shorter tiers, with whole texts where one fits and then with the
front of one that does not, whose rest is routed again. So windows are full but
for the last one of a group. Full windows of one size are then numbered, and
dealt to steps of equal numbers of tokens, the sizes evenly spread over the steps.
"""

from __future__ import annotations

import functools
from bisect import bisect_right, insort
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsukiori.llm import textbytes as tb
from tsukiori.llm.pretokens import WordCache
from tsukiori.llm.simple8b import Encoder
from tsukiori.scratch import new_path, stage

#: Context sizes in tokens, ascending powers of two.
SIZES = (256, 512, 1024, 2048)
#: Documents, about, that are packed together.
GROUP = 4000
#: Tokens of a step, a multiple of the largest size.
STEP = 1 << 17
#: Bytes of an id: all ids are little-endian unsigned 32-bit integers.
WIDTH = 4
#: Words whose ids a worker keeps.
CACHED = 1 << 18

_PLAN = "key long, start long, length long, size int, local long, offset long"


@functools.cache
def _encoder(path: str) -> Encoder:
    encoder = Encoder(path)
    encoder.cache = WordCache(encoder.cache.encode, CACHED)
    return encoder


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``doc_tokens`` and ``ids`` (binary) of each document, ``end_id`` last."""
    outputs = [T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]

    def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        found, counts = _encoder(tokenizer).ids(data, offsets)
        ids = np.insert(found, np.cumsum(counts), end_id).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(counts + 1) * WIDTH]).astype(np.int32)
        return [pa.array(counts + 1, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])]

    source = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    return tb.per_document(source, "text", ["doc_id"], outputs, lambda: work)


class _Tier:
    """Texts of one tier, by length: ``(length, document, first token)``."""

    def __init__(self) -> None:
        self.texts: list[tuple[int, int, int]] = []

    def longest(self, most: int) -> tuple[int, int, int] | None:
        """Take the longest text of at most so many tokens."""
        at = bisect_right(self.texts, (most + 1, -1, -1))
        return self.texts.pop(at - 1) if at else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self.texts.pop(0) if self.texts else None


def plan(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES) -> list[tuple[int, int, int, int, int, int]]:
    """Pieces of the documents of a group: document, start, length, size of the window, its number within the size, offset.

    All windows but one at most are full; that one counts as one of the largest size.
    """
    largest = sizes[-1]
    pieces, made = [], dict.fromkeys(sizes, 0)
    tiers = [_Tier() for _ in sizes]

    def route(text: tuple[int, int, int]) -> None:
        insort(tiers[int(np.searchsorted(sizes, text[0]))].texts, text)

    def emit(window: list[tuple[int, int, int]], size: int) -> None:
        offset = 0
        for length, doc, start in window:
            pieces.append((doc, start, length, size, made[size], offset))
            offset += length
        made[size] += 1

    for doc, length in enumerate(lengths.tolist()):
        full = length // largest
        for i in range(full):
            emit([(largest, doc, i * largest)], largest)
        if length % largest:
            route((length % largest, doc, full * largest))
    for own in reversed(range(len(sizes))):
        size = sizes[own]
        while (first := tiers[own].longest(size)) is not None:
            window, gap = [first], size - first[0]
            for tier in (*reversed(tiers[:own]), *tiers[own : own + 1]):  # whole texts, from shorter tiers first
                while gap and (text := tier.longest(gap)) is not None:
                    window.append(text)
                    gap -= text[0]
            while gap:  # then the front of one that is longer than the gap
                text = next((x for tier in (*tiers[:own], tiers[own]) if (x := tier.shortest()) is not None), None)
                if text is None:
                    break
                length, doc, start = text
                window.append((min(gap, length), doc, start))
                if length > gap:
                    route((length - gap, doc, start + gap))
                gap -= min(gap, length)
            emit(window, largest if gap else size)
    return pieces


def _planned(tokens: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The pieces of all groups, each with its group."""
    groups = max(1, -(-tokens.count() // GROUP))

    def pack(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        pieces = np.array(plan(rows["doc_tokens"].to_numpy(), sizes), np.int64).reshape(-1, 6)
        keys = rows["key"].to_numpy()[pieces[:, 0]]
        made = {"key": keys, "start": pieces[:, 1], "length": pieces[:, 2], "size": pieces[:, 3], "local": pieces[:, 4], "offset": pieces[:, 5]}
        return pd.DataFrame(made | {"group": group[0]})

    deal = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")
    return tokens.select("key", "doc_tokens", deal).groupBy("group").applyInPandas(pack, f"{_PLAN}, group long")


def _step(totals: dict[int, int], step: int) -> Column:
    """The step of the window of number ``index`` among those of its ``size``.

    Step i of the n of a size stands at (2i + 1) / 2n of the way; steps are numbered
    in this order, of several at one place those of the smaller size first.
    """
    steps = {size: -(-count * size // step) for size, count in totals.items()}
    chosen = F.lit(None).cast("long")
    for size, n in steps.items():
        own = f"(index * {size} div {step})"
        others = [f"(((2 * {own} + 1) * {m} + {n} - {int(other > size)}) div {2 * n})" for other, m in steps.items() if other != size]
        chosen = F.when(F.col("size") == size, F.expr(" + ".join([own, *others]))).otherwise(chosen)
    return chosen


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, *, sizes: tuple[int, ...] = SIZES, step: int = STEP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of all documents, in sequences of the given context sizes.

    Columns ``doc_id``, ``start`` (ids of the document before the piece), ``length``,
    ``ids`` (binary, ``WIDTH`` bytes each), ``doc_tokens`` (ids of the document, the end id included),
    ``sequence_id`` (long, from 0 without gaps), ``offset`` (in the sequence, from 0
    without gaps), ``size`` (of the sequence) and ``step`` (from 0 without gaps).

    ``tokenizer`` is a file of the tokenizers library, of a byte-level kind (see
    ``simple8b.Encoder``). Each id of a document, and ``end_id`` after its last, lies
    in one piece. Sequences hold exactly ``size`` ids, but for one of the largest
    size in each group of about ``GROUP`` documents. A step has ``step`` ids in
    sequences of one size, but the last step of each size.

    Null and empty texts have the end id only. A document is a row, so those that
    share an id are packed each by itself; a null id stays null. Without documents
    there are no rows. Other columns are not looked at.

    Ids are written once and shuffled once, to meet their pieces; planning sees
    lengths only. Of each group, the numbers of its sequences meet in one place.
    """
    tokens = encode_documents(docs, tokenizer, end_id, doc_id=doc_id, text=text)
    tokens = tokens.withColumn("key", F.monotonically_increasing_id())
    path = new_path(docs.sparkSession, "tokens")
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = docs.sparkSession.read.schema(tokens.schema).parquet(path)
    planned = stage(_planned(tokens, sizes), "plan")
    made = planned.groupBy("group", "size").agg((F.max("local") + 1).alias("n"))
    made = stage(made.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("group")) - F.col("n")), "sequences")
    totals = {row["size"]: row["n"] for row in made.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()}
    first = F.lit(0).cast("long")
    for size in totals:
        first = F.when(F.col("size") == size, F.lit(sum(n for s, n in totals.items() if s < size)).cast("long")).otherwise(first)
    numbered = planned.join(made.drop("n"), ["group", "size"]).withColumn("index", F.col("before") + F.col("local"))
    numbered = numbered.select("key", "start", "length", (first + F.col("index")).alias("sequence_id"), "offset", "size", _step(totals, step).alias("step"))
    fields = ["start", "length", "sequence_id", "offset", "size", "step"]
    pieces = numbered.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))

    def cut(piece: Column) -> Column:
        ids = F.substring("ids", (piece["start"] * WIDTH + 1).cast("int"), (piece["length"] * WIDTH).cast("int"))
        return F.struct("doc_id", *[piece[x].alias(x) for x in fields], ids.alias("ids"), "doc_tokens")

    rows = tokens.join(pieces, "key").select(F.inline(F.transform("pieces", cut)))
    return rows.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "size", "step")


def sequences(pieces: DataFrame, pad_id: int) -> DataFrame:
    """``sequence_id``, ``step``, ``ids`` (binary, padded to the sequence's size) and ``n_pad`` of each sequence."""
    rows = pieces.groupBy("sequence_id", "step", "size").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda made, part: F.concat(made, part["ids"]))
    n_pad = F.col("size") - (F.length("whole") / WIDTH).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(WIDTH, "little").hex()), n_pad))
    return rows.withColumn("whole", ids).select("sequence_id", "step", F.concat("whole", pad).alias("ids"), n_pad.cast("long").alias("n_pad"))
