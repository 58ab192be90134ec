"""Token counts: greedy longest-match pieces of words, by a linear automaton.

The automaton is a trie of the vocabulary's byte strings with failure links. A
node's link leads to where matching goes on once the longest pieces at the start
of its string are cut off, and the node knows how many these are. So a word
costs one step a byte, and no piece is ever built. All words of a batch take
their steps together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsukiori.llm import textbytes as tb


def read_vocabulary(path: str) -> list[bytes]:
    """The byte strings of a rank file: a base64 text and a number a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class Automaton:
    row: np.ndarray  # of each node: its row in goto; row 0 is empty
    goto: np.ndarray  # by row and byte: the child, or 0
    link: np.ndarray
    popped: np.ndarray  # pieces cut off when the link is taken
    rest: np.ndarray  # pieces of a word that ends at the node


def build(vocabulary: Iterable[bytes]) -> Automaton:
    """The automaton; node 0 is the root. Every single byte must be a piece."""
    vocabulary = sorted(set(vocabulary))
    if sum(len(piece) == 1 for piece in vocabulary) != 256:
        raise ValueError("the vocabulary lacks single bytes")
    children: list[dict[int, int]] = [{}]
    final = [False]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            child = children[node].get(byte)
            if child is None:
                child = children[node][byte] = len(children)
                children.append({})
                final.append(False)
            node = child
        final[node] = bool(piece)
    size = len(children)
    link, popped, rest = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    queue = [0]
    for node in queue:
        for byte, child in children[node].items():
            if final[child]:
                link[child], popped[child] = 0, 1
            else:
                at, count = int(link[node]), int(popped[node])
                while byte not in children[at]:
                    count += int(popped[at])
                    at = int(link[at])
                link[child], popped[child] = children[at][byte], count
            rest[child] = popped[child] + rest[link[child]]
            queue.append(child)
    inner = [node for node in range(size) if children[node]]
    row = np.zeros(size, np.int32)
    row[inner] = np.arange(1, len(inner) + 1)
    goto = np.zeros((len(inner) + 1, 256), np.int32)
    for node in inner:
        goto[row[node], list(children[node])] = list(children[node].values())
    return Automaton(row, goto, link, popped, rest)


def count_pieces(machine: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pieces of each word, taken with one space before it."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: those still at work are a prefix
    starts, lengths = starts[order], (ends - starts)[order]
    node = np.full(len(starts), machine.goto[machine.row[0], 0x20], np.int32)
    count = np.zeros(len(starts), np.int64)
    going = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for step, active in enumerate(going):
        byte, at = data[starts[:active] + step], node[:active]
        child = machine.goto[machine.row[at], byte]
        stuck = np.flatnonzero(child == 0)
        while len(stuck):
            count[stuck] += machine.popped[at[stuck]]
            at[stuck] = machine.link[at[stuck]]
            child[stuck] = machine.goto[machine.row[at[stuck]], byte[stuck]]
            stuck = stuck[child[stuck] == 0]
        node[:active] = child
    count += machine.rest[node]
    out = np.empty(len(order), np.int64)
    out[order] = count
    return out


_built: dict[str, Automaton] = {}


def token_counts(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns of each document, its words and its word-pieces.

    ``vocabulary`` is the path of a rank file, present on every worker. Words
    are separated by ASCII white space; each is matched with one space before
    it, which marks a word's start in the vocabulary. From left to right, the
    longest piece of the vocabulary is taken.

    Adds ``n_words`` and ``n_tokens`` (long). Null and empty texts have none.
    Repeated documents each get their row; other columns are not looked at, and
    kept ones with the added names are replaced. No shuffle; a task holds the
    automaton (its size is the vocabulary's) and two megabytes of text, or one
    text.
    """

    def make() -> tb.Work:
        if vocabulary not in _built:
            _built[vocabulary] = build(read_vocabulary(vocabulary))
        machine = _built[vocabulary]

        def work(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            starts, ends = tb.runs(tb.SOLID[data], offsets)
            bounds = tb.owners(starts, offsets)
            totals = np.concatenate([[0], np.cumsum(count_pieces(machine, data, starts, ends))])
            return [pa.array(np.diff(bounds), pa.int64()), pa.array(totals[bounds[1:]] - totals[bounds[:-1]], pa.int64())]

        return work

    outputs = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return tb.per_document(docs, text, keep, outputs, make)
