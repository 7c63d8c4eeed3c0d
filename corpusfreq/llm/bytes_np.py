"""Vectorised views of the UTF-8 bytes of whole batches of texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are taken together until they have this many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 18


def _lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = _lower_table()
# White space of words: blank, tab to carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, stop row, bytes, offsets) over the texts of a column; null is empty.

    ``offsets`` has one entry more than rows and starts at 0.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD):
    """(start, stop, row) of every word: maximal runs of word bytes inside a text."""
    word = is_word[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    opens[edges] = word[edges]
    closes[edges - 1] = word[edges - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, stops, rows


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# Values of a byte at each of the first positions of a word.
POSITIONS = 256
_PLACED = mix(np.arange(1, 256 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).reshape(POSITIONS, 256)
_PLACED = np.ascontiguousarray(_PLACED[:, LOWER]).reshape(-1)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z taken as a-z; equal words hash alike everywhere.

    The hash is the mixed sum of one pseudo-random value for every byte and its position, so
    no pattern of repetitions makes different words collide: any two differ but for a chance
    of about 2**-64. Words do not overlap, rise and are not empty.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    total = int(first[-1] + sizes[-1])
    small = np.int32 if len(data) < 1 << 30 else np.int64
    count = np.arange(total, dtype=small)
    place = count - np.repeat(first.astype(small), sizes)
    count += np.repeat((starts - first).astype(small), sizes)  # now each byte's place in the data
    longest = int(sizes.max())
    at = (place & small(POSITIONS - 1)) if longest > POSITIONS else place.copy()
    at <<= 8
    at += data[count]
    values = _PLACED[at]
    if longest > POSITIONS:
        far = np.flatnonzero(place >= POSITIONS)
        values[far] = mix(values[far] ^ mix((place[far] // POSITIONS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))
