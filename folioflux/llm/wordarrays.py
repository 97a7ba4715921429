"""Words of many texts as numpy arrays: where they begin and end in the bytes of an Arrow batch, and 64-bit hashes.

A batch is taken in slices of bounded bytes, so that memory doesn't grow with the number or length of texts in it; one
text longer than the bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; the arrays beside them take about 40 times that.
SLICE_BYTES = 1_000_000

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_PLACES = 1024
_STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _factors(place: np.ndarray, which: int) -> np.ndarray:
    """An odd 64-bit factor for each place of a word, however far: the place, mixed."""
    with np.errstate(over="ignore"):
        x = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP[which])
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) | np.uint64(1)


# powers for the first places, mixed factors for all others: powers alone would take some long words for equal
_PLACE = np.stack([_factors(np.arange(_PLACES), which) for which in (0, 1)])
_PLACE[:, :64] = np.cumprod(np.full((2, 64), [[_STEP[0]], [_STEP[1]]], dtype=np.uint64), axis=1, dtype=np.uint64)

#: Bytes of words: digits, letters and everything outside ASCII. A-Z are lower-cased first.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@dataclass
class Words:
    """The words of a slice: byte ranges [start, end) in `data`, the text each belongs to, and where each text's words
    begin and end among all (`bounds`, one more than there are texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; `which` chooses one of two independent functions."""
        return hash_ranges(self.data, self.start, self.end, which)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of non-empty byte ranges that don't overlap and stand in order."""
    size = (end - start).astype(np.int64)
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    byte = data[place + np.repeat(start.astype(np.int64), size)]
    factor = _PLACE[which][np.minimum(place, _PLACES - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        factor[far] = _factors(place[far], which)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[which][byte] * factor, first)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, accents: bool = False) -> Words:
    """The words of texts that stand end to end in `data` (bytes), text i at offsets[i] to offsets[i + 1].

    accents: capital letters of the Latin-1 block are lower-cased too.
    """
    data = _LOWER[data]
    if accents and len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        data[capital] += 32
    inside = IS_WORD[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    met = cut[inside[cut] & inside[cut - 1]]  # a text that ends with a word, and one that begins with a word
    where = np.flatnonzero(edge)
    if len(met):
        where = np.sort(np.concatenate([where, met, met]))
    start, end = where[::2], where[1::2]
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data, start, end, doc, bounds)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, data, offsets) of consecutive texts, null as empty, of at most `limit` bytes or one text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
