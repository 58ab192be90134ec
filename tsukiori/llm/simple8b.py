"""Token ids as files: Simple-8b words, with offsets for decoding blocks at a time.

A 64-bit word has a selector in its top four bits, which says how many ids of how
many bits the other 60 hold. Selector 0 is an escape: the next word is one id of
up to 64 bits. Ids are packed in blocks that start a new word, so a reader
decodes any block by itself, and all blocks of a batch at once.

The files are Parquet with a row per document, in ascending order over files and
rows: ``part`` (number of the file in that order), ``doc_id``, ``before`` (ids of
the documents before it in the file), ``n_tokens``, ``words`` (binary: the words, little-endian) and ``blocks`` (array of int: number
of the first word of each block of ``BLOCK`` ids).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tsukiori.llm import textbytes as tb
from tsukiori.llm.pretokens import WordCache, split

#: Ids of a block.
BLOCK = 256
#: Ids per word by selector, and their bits; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
_PACKED = range(1, 15)

_U = np.uint64


#: Of an id of so many bits: how many of that size a word can hold; 0 if it needs an escape.
_ROOM = np.array([next((int(COUNTS[n]) for n in _PACKED if BITS[n] >= bits), 0) for bits in range(65)])
#: The selector for so many ids at least that fit, and how many it takes.
_SELECTOR = np.array([0, *(next(n for n in _PACKED if COUNTS[n] <= most) for most in range(1, 61))])


def encode(ids: np.ndarray, block_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for all blocks, and the number of words of each.

    ``block_starts`` has the first position of each block, none of them empty.
    Within a block each word takes as many ids as any selector allows. All
    blocks make their next word together.
    """
    ids = ids.astype(_U)
    if not len(ids):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    bits = np.frexp(ids.astype(float))[1]  # may be one too many for more than 52 bits, which only costs room
    room = _ROOM[np.minimum(bits, 64)]
    stop = np.append(block_starts[1:], len(ids))
    position, lane, cursor = block_starts.copy(), np.arange(len(block_starts)), np.zeros(len(block_starts), np.int64)
    made = []
    while len(position):
        fits = np.zeros(len(position), np.int64)
        least, open_ = np.full(len(position), 60), np.arange(len(position))
        for k in range(60):
            least = np.minimum(least, room[position[open_] + k])
            going = least > k
            fits[open_[going]] = k + 1
            going &= (position[open_] + k + 1 < stop[open_]) & (least > k + 1)
            open_, least = open_[going], least[going]
            if not len(open_):
                break
        final = position + fits >= stop  # the last word of a block may be short
        selector = _SELECTOR[fits]
        if final.any():
            selector[final] = _short(room, position[final], fits[final])
        taken = np.where(final, fits, COUNTS[selector])
        taken[fits == 0], selector[fits == 0] = 1, 0
        made.append((position, selector, taken, lane, cursor[lane]))
        cursor[lane] += np.where(selector == 0, 2, 1)
        position = position + taken
        going = position < stop
        position, stop, lane = position[going], stop[going], lane[going]
    at, chosen, held, lane, place = (np.concatenate(x) for x in zip(*made, strict=True))
    target = (np.cumsum(cursor) - cursor)[lane] + place
    words = np.zeros(int(cursor.sum()), _U)
    word = chosen.astype(_U) << _U(60)
    for number in _PACKED:
        mine = np.flatnonzero(chosen == number)
        short = held[mine] < COUNTS[number]
        for some, count in ((mine[~short], int(COUNTS[number])), *((mine[[i]], int(held[mine[i]])) for i in np.flatnonzero(short))):
            if len(some):
                packed, first = word[some], at[some]
                for k in range(count):
                    packed |= ids[first + k] << _U(k * int(BITS[number]))
                word[some] = packed
    words[target] = word
    words[target[chosen == 0] + 1] = ids[at[chosen == 0]]
    return words, cursor


def _short(room: np.ndarray, position: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Selectors for last words: of those with room for all ids, the one of most bits."""
    least = np.full(len(position), 60)
    for k in range(int(fits.max()) if len(fits) else 0):
        some = fits > k
        least[some] = np.minimum(least[some], room[position[some] + k])
    return _SELECTOR[least]


def decode(words: np.ndarray, block_words: np.ndarray, block_ids: np.ndarray) -> np.ndarray:
    """The ids of all blocks, given the number of words and of ids of each."""
    if not len(words):
        return np.zeros(0, _U)
    selector = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # the word after an escape is an id, whatever its top bits
    suspects = np.flatnonzero(selector == 0)
    if len(suspects):
        run = np.ones(len(suspects), bool)
        run[1:] = np.diff(suspects) != 1
        place = np.arange(len(suspects)) - np.maximum.accumulate(np.where(run, np.arange(len(suspects)), 0))
        after = suspects[place % 2 == 0] + 1
        raw[after[after < len(words)]] = True
    block = np.repeat(np.arange(len(block_words)), block_words)
    head = np.flatnonzero(~raw)
    chosen, block = selector[head], block[head]
    most = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]  # ids before, were all words full
    opens = np.ones(len(head), bool)
    opens[1:] = block[1:] != block[:-1]
    within = most - np.repeat(most[opens], np.diff(np.append(np.flatnonzero(opens), len(head))))
    first = np.cumsum(block_ids) - block_ids
    count = np.minimum(COUNTS[chosen], block_ids[block] - within)
    start = first[block] + within
    ids = np.zeros(int(block_ids.sum()), _U)
    for number in _PACKED:
        mine = np.flatnonzero(chosen == number)
        mask = _U((1 << int(BITS[number])) - 1)
        for k in range(int(COUNTS[number]) if len(mine) else 0):
            some = mine[count[mine] > k]
            ids[start[some] + k] = words[head[some]] >> _U(k * int(BITS[number])) & mask
    escaped = chosen == 0
    ids[start[escaped]] = words[head[escaped] + 1]
    return ids


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each document: its words as bytes, and the number of the first word of each block."""
    ends = np.cumsum(counts)
    n_blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), n_blocks)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    words, sizes = encode(ids, (ends - counts)[doc] + within * BLOCK)
    per_doc = np.bincount(doc, weights=sizes, minlength=len(counts)).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    base = (np.cumsum(per_doc) - per_doc)[doc]
    offsets = np.concatenate([[0], np.cumsum(per_doc * 8)]).astype(np.int32)
    blob = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(words.astype("<u8"))])
    return blob, tb.lists(before - base, n_blocks, pa.int32())


def unpack(words: pa.Array, blocks: pa.Array, counts: np.ndarray) -> np.ndarray:
    """All ids of the documents of a batch."""
    data, offsets = tb.flat(words)
    flat = np.frombuffer(np.ascontiguousarray(data).tobytes(), "<u8").astype(_U)
    per_doc = np.diff(offsets) // 8
    starts = blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n_blocks = -(-counts // BLOCK)
    doc = np.repeat(np.arange(len(counts)), n_blocks)
    last = np.cumsum(n_blocks) - 1
    following = np.append(starts[1:], 0)
    following[last[n_blocks > 0]] = per_doc[n_blocks > 0]
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    return decode(flat, following - starts, np.minimum(BLOCK, counts[doc] - within * BLOCK))


class Encoder:
    """The ids of texts by a byte-level tokenizer file.

    Texts are cut at the file's added tokens, each of which is one id; what lies
    between is split into words as if it were a text, as the library does.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if any(token.single_word or token.lstrip or token.rstrip for token in added.values()):
            raise ValueError("an added token depends on what is beside it")
        if len({token.normalized for token in added.values()}) > 1:
            raise ValueError("the added tokens are not matched all at once")
        self.added = {token.content.encode(): number for number, token in added.items() if token.content}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        tokenizer.encode_special_tokens = True  # in a word there is none, and none may arise between two
        tokenizer.no_padding()
        tokenizer.no_truncation()

        def encode(words: str) -> list[int]:
            return tokenizer.encode_batch_fast([words], add_special_tokens=False)[0].ids

        self.cache = WordCache(encode)

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts, ends and ids of the added tokens in the texts, a row of three for each."""
        whole, rows = data.tobytes(), []
        if self.pattern is not None and self.pattern.search(whole):
            for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                rows += [(m.start(), m.end(), self.added[m[0]]) for m in self.pattern.finditer(whole, start, stop)]
        return np.array(rows, np.int64).reshape(-1, 3)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many of them each text has."""
        added = self._added(data, offsets)
        starts = split(data, np.concatenate([offsets, added[:, 0], added[:, 1]]))
        ends = np.append(starts[1:], len(data))[: len(starts)]
        inside = np.searchsorted(added[:, 0], starts, "right") > np.searchsorted(added[:, 1], starts, "right")
        found, counts = self.cache.look_up(data, starts[~inside], ends[~inside])
        if len(added):
            place = np.searchsorted(starts[~inside], added[:, 0])  # the words before it
            at = np.concatenate([[0], np.cumsum(counts)])[place]
            found, counts = np.insert(found, at, added[:, 2]), np.insert(counts, place, 1)
            starts = np.insert(starts[~inside], place, added[:, 0])
        reach = np.concatenate([[0], np.cumsum(counts)])[tb.owners(starts, offsets)]
        return found, np.diff(reach)


_loaded: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of a worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int, order: str = "doc_id", text: str = "text"
) -> None:
    """Encode each text, append ``end_id``, and write the ids to files below ``path``.

    ``tokenizer`` is a file of the tokenizers library, present on every worker,
    of a byte-level kind, which encodes each word of its split by itself; so each
    worker keeps what the library made of words. Added tokens of the file, special
    or not, are recognised in texts as the library does by default; special tokens
    are not added. Documents go to
    files by ranges of ``order``, whose bounds Spark samples, and are sorted
    within; so the files in order hold all documents in ascending order. Only
    the texts are shuffled, once.

    Null and empty texts have the end id only. A null ``order`` comes first;
    documents that share one are in order of a hash of their text. Other columns
    are not written. A task holds two megabytes of text, or one text, at a time.
    """
    spark = docs.sparkSession
    source = docs.select(docs[f"`{order}`"].alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    outputs = [
        T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("blocks", T.ArrayType(T.IntegerType())),
    ]

    def make() -> tb.Work:
        encoder, before = _encoder(tokenizer), 0

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            nonlocal before
            found, counts = encoder.ids(data, offsets)
            counts = counts + 1
            ends = np.cumsum(counts)
            ids = np.full(int(ends[-1]), end_id, np.int64)
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner] = found
            first, before = before + ends - counts, before + int(ends[-1])
            return [pa.array(first, pa.int64()), pa.array(counts, pa.int64()), *pack(ids, counts)]

        return work

    packed = tb.per_document(ordered, "text", ["doc_id"], outputs, make)
    packed.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start``, ``n_tokens`` and the files' words.

    ``start`` is the number of ids of all documents before: of those in the same
    file, which the file has, and of all files before. A sum per file is all
    that meets in one place and is sent to all tasks.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = totals.select("part", earlier.alias("earlier"))
    return files.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "words", "blocks"
    )


def with_ids(rows: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray], list[pa.Array]]], outputs: list[T.StructField]) -> DataFrame:
    """Adds what a function makes of the decoded ids of each batch, given them and the number of each document's."""
    schema = T.StructType([*rows.drop("words", "blocks").schema, *outputs])
    names = [field.name for field in schema]
    source = rows.select(*names[: len(names) - len(outputs)], "words", "blocks")
    at = names.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start, stop in tb.slices(batch.column(len(batch.columns) - 2)):
                part = batch.slice(start, stop - start)
                counts = part.column(at).to_numpy().astype(np.int64)
                ids = unpack(part.columns[-2], part.columns[-1], counts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *work(ids, counts)], names=names)

    return source.mapInArrow(run, schema)


def checksums(rows: DataFrame) -> DataFrame:
    """Adds ``ids_crc32``: of each document's ids as little-endian 32-bit integers."""

    def make():
        def work(ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
            data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            return [pa.array([zlib.crc32(data[end - 4 * n : end]) for n, end in zip(counts, ends, strict=True)], pa.int64())]

        return work

    return with_ids(rows, make, [T.StructField("ids_crc32", T.LongType())])
