"""Texts of an Arrow batch as one array of UTF-8 bytes, and what can be read off it.

All functions work on whole arrays; none loops over documents or words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text worked on at a time, if a single text is not longer: bounds a task's memory.
SLICE_BYTES = 2 << 20

Work = Callable[..., list[pa.Array]]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the offsets of the texts in them. Null texts are empty."""
    return flat(pc.fill_null(texts, ""))


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts or binaries, none of them null, and the offsets of the values in them."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    values = pc.cast(values, pa.large_string() if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    blob = values.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, stop
        start = stop


def per_document(
    docs: DataFrame, text: str, keep: Iterable[str], outputs: list[T.StructField], make: Callable[[], Work],
    also: Iterable[str] = (),
) -> DataFrame:
    """One row per document: the kept columns, then what the work says of its text.

    ``make`` runs once in a task and gives the work, which gets bytes, offsets
    and the columns named in ``also``, and returns an array per output. A kept column with the name of an
    output gives way to it.
    """
    names = {field.name.lower() for field in outputs}
    keep = [name for name in dict.fromkeys(keep) if name.lower() not in names]
    source = docs.select(*[docs[f"`{name}`"].alias(f"k{i}") for i, name in enumerate(keep)], docs[f"`{text}`"].cast("string").alias("text"), *[docs[f"`{name}`"].alias(f"a{i}") for i, name in enumerate(also)])
    fields = [T.StructField(name, docs.schema[name].dataType) for name in keep]
    schema = T.StructType([*fields, *outputs])
    labels = [field.name for field in schema]
    count = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(count)
            for start, stop in slices(texts):
                part = batch.slice(start, stop - start)
                made = work(*utf8(part.column(count)), *part.columns[count + 1 :])
                yield pa.RecordBatch.from_arrays([*part.columns[:count], *made], names=labels)

    return source.mapInArrow(run, schema)


def byte_table(members: Callable[[int], bool]) -> np.ndarray:
    return np.array([members(b) for b in range(256)])


#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: What is a word's byte: letters, digits and all beyond ASCII.
ALNUM = byte_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: All but ASCII white space.
SOLID = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, none across two texts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's runs: those of text i are ``bounds[i]:bounds[i + 1]``."""
    return np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the splitmix64 finaliser)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def random_words(seed: int, count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed << 32))


class Rolling:
    """Hashes of any substrings of a byte array, from one pass over it.

    The hash of bytes b0..bn is the sum of code[b] * base**i modulo 2**64, by
    prefix sums and the inverse powers of an odd base. Two with other seeds are
    independent.
    """

    def __init__(self, seed: int):
        self.code = random_words(seed, 256) | np.uint64(1)
        base = int(random_words(seed + 1, 1)[0]) | 5
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, count: int) -> None:
        if len(self.up) < count:
            count = 1 << count.bit_length()
            up, down = np.full(count, self.base, np.uint64), np.full(count, self.inverse, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from starts to ends, lengths mixed in."""
        got = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(got + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def same_bytes(
    one: np.ndarray, one_starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """For each pair of substrings of equal length: are they the same bytes?"""
    if not len(lengths):
        return np.zeros(0, bool)
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    same = one[np.repeat(one_starts, lengths) + at] == other[np.repeat(other_starts, lengths) + at]
    wrong = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=~same, minlength=len(lengths))
    return wrong == 0


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
