"""Words of whole texts as 64-bit hashes, for code that runs inside tasks on Arrow batches.

Everything here works on one batch of texts at a time, in slices of half a megabyte, so the
memory of a task doesn't depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 19

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)

_ALL = np.arange(256)
SPACE = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
_UPPER = (_ALL >= 65) & (_ALL <= 90)
#: Everything in ASCII but digits and letters.
NO_LETTER = (_ALL < 128) & ~((_ALL >= 48) & (_ALL <= 57)) & ~_UPPER & ~((_ALL >= 97) & (_ALL <= 122))
LOWERED = np.where(_UPPER, _ALL + 32, _ALL).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking value for each byte, the same for A-Z as for a-z.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))[LOWERED]
#: The same for the capitals of Latin-1 (second bytes 80 to 9E) as for their small letters.
CASELESS_VALUE = BYTE_VALUE[np.where((_ALL >= 0x80) & (_ALL <= 0x9E), _ALL + 32, _ALL)]


class Powers:
    """Powers of the hash's factor and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
                steps = np.full(n + 1, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, each of at least one text."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


@dataclass
class Words:
    """Word hashes of some texts in order; text ``i`` has the words ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(data: np.ndarray, at: np.ndarray, powers: Powers, between: np.ndarray = SPACE, values: np.ndarray = BYTE_VALUE) -> Words:
    """Hash the words (runs of bytes not in ``between``), A-Z as a-z, of the texts cut at ``at``."""
    data, at = data[at[0] : at[-1]], at - at[0]
    if not len(data):
        return Words(np.empty(0, np.uint64), np.zeros(len(at), np.int64))
    inside = ~between[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~(inside[1:] & ~edge[1:-1])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, at))


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and the text of each; a shorter text is one run, an empty one none."""
    hashes, counts = words.hashes, words.counts
    text = words.text_of()
    total = len(hashes) - n + 1
    if total > 0:
        runs = np.zeros(total, np.uint64)
        for j in range(n):
            runs = runs * np.uint64(_FACTOR) + hashes[j : j + total]
        whole = text[:total] == text[n - 1 :]
        runs, of = mix(runs)[whole], text[:total][whole]
    else:
        runs, of = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            more = counts[short] > j
            at = np.minimum(words.first[short] + j, max(len(hashes) - 1, 0))
            one = np.where(more, one * np.uint64(_FACTOR) + hashes[at] + np.uint64(1), one)
        runs, of = np.concatenate([runs, mix(one)]), np.concatenate([of, short])
    return runs, of


def sets_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ``n`` words of each text, sorted: hashes, and where each text's begin."""
    runs, of = shingles_of(words, n)
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    runs, of = runs[new], of[new]
    return runs, np.searchsorted(of, np.arange(len(words.first)))


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a task as one table, None where there are none."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None
