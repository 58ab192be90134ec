"""The words that a byte-level tokenizer splits a text into, found by array operations.

The split is that of the pattern the byte-level vocabularies are made for:
contractions after an apostrophe, runs of letters, of numbers and of other
characters, each with a space before it, and what white space is left.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

from tsukiori.llm import textbytes as tb

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The characters of Unicode's White_Space property.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a word of its own.
_CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        first = unicodedata.category(chr(point))[0]
        if first in "LN":
            kinds[point] = _LETTER if first == "L" else _NUMBER
    kinds[_SPACES] = _SPACE
    return kinds


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The characters that start at the given bytes, none of them ASCII."""
    first = data[lead].astype(np.int32)
    rest = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (first & 0x1F) << 6 | rest[0]
    three = (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
    four = (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    return np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = _classes()
    kinds = table[:256].copy()
    kinds = kinds[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        lead = high[data[high] >= 0xC0]
        kinds[lead] = table[code_points(data, lead)]
        tail = high[data[high] < 0xC0]
        kinds[tail] = kinds[lead[np.searchsorted(lead, tail) - 1]]
    return kinds


def split(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first bytes of all words. A word ends where the next starts, or its text ends."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    kinds = _kinds(data)
    text_start = np.zeros(size + 1, bool)
    text_start[offsets] = True
    change = text_start.copy()  # a run of one class starts here, or all ends
    change[1:-1] |= kinds[1:] != kinds[:-1]
    change[-1] = True
    space = kinds == _SPACE
    starts = change[:-1].copy()
    run = np.flatnonzero(starts & ~space & ~text_start[:-1])
    starts[run[data[run - 1] == 0x20]] = False  # the space before it belongs to it
    follows = np.flatnonzero(change[1:-1] & ~text_start[1:-1] & space[:-1])  # last byte of white space before a word
    while len(back := np.flatnonzero((data[follows] & 0xC0) == 0x80)):
        follows[back] -= 1
    starts[follows] = True
    mark = np.flatnonzero((data == 0x27) & starts)  # an apostrophe without a space before it
    for tail in _CONTRACTIONS:
        some = mark[mark + len(tail) < size]
        for k, byte in enumerate(tail):
            some = some[(data[some + 1 + k] == byte) & ~text_start[some + 1 + k]]
        starts[some + 1] = False
        after = some + 1 + len(tail)
        starts[after[after < size]] = True
    return np.flatnonzero(starts)


class WordCache:
    """What a tokenizer makes of single words, kept for the life of a worker.

    Words are known by two 64-bit hashes, and each has a place by either in a
    table of fixed size; a word that finds both taken drives out the other. When
    ``most`` words are held, all are forgotten. So the memory is bounded, and
    every word is encoded by the tokenizer, if not each time.

    ``encode`` gives the ids of one text. New words are encoded as one text, with
    line feeds between them: one is a word by itself before any word that does
    not end in white space, and its own id marks where the next word's start.
    """

    def __init__(self, encode: Callable[[str], list[int]], most: int = 1 << 21):
        self.encode, self.most = encode, most
        self.rolling = tb.Rolling(8), tb.Rolling(9)
        self.bits = most.bit_length() + 1
        (self.mark,) = encode("\n")
        self._empty()

    def _empty(self) -> None:
        self.slot = np.zeros(1 << self.bits, np.int32)  # number of the word kept there; 0 is none
        self.hashes = np.zeros((2, 1 << 12), np.uint64)
        self.start = np.zeros((1 << 12) + 1, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.count = 1

    def _add(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        texts = [word.decode() for word in words]
        alone = np.array([text[-1].isspace() or "\n" in text for text in texts])
        order = np.argsort(alone, kind="stable")
        joined = np.array(self.encode("".join(f"\n{texts[i]}" for i in order[: len(order) - alone.sum()])), np.int32)
        cuts = np.flatnonzero(joined == self.mark)
        if len(cuts) + alone.sum() != len(texts):
            raise ValueError("the tokenizer does not keep a line feed apart")
        made = [self.encode(texts[i]) for i in order[len(cuts) :]]
        lengths = np.concatenate([np.diff(np.append(cuts, len(joined))) - 1, np.array([len(ids) for ids in made], np.int64)])
        flat = np.concatenate([joined[joined != self.mark], *(np.array(ids, np.int32) for ids in made)])
        hashes = hashes[:, order]
        count, used = self.count + len(texts), int(self.start[self.count]) + len(flat)
        while self.hashes.shape[1] < count:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
            self.start = np.concatenate([self.start, np.zeros(len(self.start) - 1, np.int64)])
        while len(self.ids) < used:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used - len(flat) : used] = flat
        self.hashes[:, self.count : count] = hashes
        self.start[self.count + 1 : count + 1] = self.start[self.count] + np.cumsum(lengths)
        numbers = np.arange(self.count, count)
        one, other = self._places(hashes)
        free = self.slot[one] == 0
        self.slot[np.where(free, one, other)] = numbers
        self.count = count
        out = np.empty_like(numbers)
        out[order] = numbers
        return out

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _is(self, number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return (number > 0) & (self.hashes[0, number] == hashes[0]) & (self.hashes[1, number] == hashes[1])

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many of them each word has."""
        if self.count > self.most:
            self._empty()
        hashes = np.stack([r.between(r.prefix(data), starts, ends) for r in self.rolling])
        one, other = self._places(hashes)
        number = self.slot[one].astype(np.int64)
        missed = np.flatnonzero(~self._is(number, hashes))
        number[missed] = self.slot[other[missed]]
        missed = missed[~self._is(number[missed], hashes[:, missed])]
        if len(missed):
            number[missed] = self._missed(data, starts[missed], ends[missed], hashes[:, missed])
        counts = self.start[number + 1] - self.start[number]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(self.start[number], counts) + within], counts

    def _missed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        _, at, same = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1, at[same]] != hashes[1]).any():  # two words of one first hash
            at = same = np.arange(len(starts))
        whole = data.tobytes()
        return self._add([whole[starts[i] : ends[i]] for i in at.tolist()], hashes[:, at])[same]
