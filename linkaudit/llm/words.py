"""Words of many texts at once, as numbers: places and hashes from running sums, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_INSIDE = np.ones(256, dtype=bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
#: Odd multipliers of the polynomials over a word's bytes, and of the steps that mix the bits of the sums.
_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def places_and_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text (runs without ASCII white space), and two hashes of 64 bits for each."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _INSIDE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    size = 1 << max(20, (len(raw) + 1).bit_length())  # few sizes, so that the powers are made once
    hashes = []
    for base in _MULTIPLIERS:
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(base, size)[: len(raw)], out=total[1:])
        # the sum of a word, brought to its own start
        h = (total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), size)[starts]
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        hashes.append(h ^ (h >> np.uint64(31)))
    return starts, ends, *hashes


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + limit)
        while end < len(text) and _INSIDE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
