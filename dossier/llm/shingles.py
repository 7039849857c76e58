"""Word shingles of texts as 64-bit hashes, for whole Arrow columns at a time.

Words are stretches without ASCII white space, A-Z in lower case. A text of at least SIZE words has its distinct runs of
SIZE words; a shorter one has its whole sequence; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
SLICE_BYTES = 2 << 20
KEPT_POWERS = 1 << 16
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least n of them; kept for the worker's next texts unless a word is very long."""
    global _POWERS
    if len(_POWERS) >= n:
        return _POWERS
    grown = np.full(max(n, 64), 0x5851F42D4C957F2D, np.uint64)
    grown[0] = 1
    grown = np.cumprod(grown, dtype=np.uint64)
    if n <= KEPT_POWERS:
        _POWERS = grown
    return grown


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it is in; bounds are the byte offsets of the rows."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    first = ~gap
    first[1:] &= gap[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] = ~gap[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.flatnonzero(~gap)
    at = np.searchsorted(inside, starts)
    place = np.arange(len(inside)) - np.repeat(at, np.diff(np.append(at, len(inside))))
    terms = (lower[inside].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(terms, at)), np.searchsorted(bounds, starts, side="right") - 1


def _sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    words, row = _word_hashes(data, bounds)
    ends = np.searchsorted(row, np.arange(len(bounds) - 1), side="right")
    begins = np.concatenate(([0], ends[:-1]))
    if len(words) >= SIZE:
        runs = len(words) - SIZE + 1
        grams = words[:runs] * _WEIGHTS[0]
        for k in range(1, SIZE):
            grams = grams + words[k:runs + k] * _WEIGHTS[k]
        grams = mixed(grams)
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        n = end - begin
        if n >= SIZE:
            yield np.unique(grams[begin:end - SIZE + 1])
        elif n:
            yield mixed((words[begin:end] * _WEIGHTS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, a few megabytes of text at a time."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        stop = min(stop, n)
        yield from _sets(data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
        start = stop
