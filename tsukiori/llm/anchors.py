"""Positions in texts that depend only on the bytes around them.

Every window of a text contributes the position in it whose next bytes have the
least hash; the leftmost of equal ones. Equal windows so contribute the same
position, wherever they are, and a text has far fewer such anchors than windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tsukiori.llm import textbytes as tb

_U = np.uint64


@dataclass
class Anchors:
    """Windows that share an anchor: their starts are ``first`` to ``last``, both included."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: by prefix and suffix minima of blocks of that width."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def find(rolling: tb.Rolling, sums: np.ndarray, offsets: np.ndarray, window: int, lead: int) -> Anchors:
    """Anchors of all texts of a batch, by the hashes of the ``lead`` bytes from each position."""
    size = int(offsets[-1])
    if size < window:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none)
    starts = np.arange(size - lead + 1)
    hashes = rolling.between(sums, starts, starts + lead)
    ranked = (hashes >> _U(32) << _U(32)) | starts.astype(_U)  # ties to the left
    least = (_sliding_min(ranked, window - lead + 1) & _U((1 << 32) - 1)).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int64)  # windows that do not cross the end of a text
    begin, end = offsets[:-1], offsets[1:] - window + 1
    some = end > begin
    np.add.at(inside, begin[some], 1)
    np.add.at(inside, np.minimum(end[some], len(least)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    text_start = np.zeros(len(least) + 1, bool)
    text_start[offsets[offsets <= len(least)]] = True
    change |= text_start[: len(least)]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(np.append((change | ~inside)[1:], True) & inside)
    return Anchors(least[first], first, stop)
