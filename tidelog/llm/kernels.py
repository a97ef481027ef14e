"""Vectorised word kernels over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  UTF-8 never
uses those bytes inside a multi-byte character, so bytes and code points agree
on where words begin and end.  Texts are handled in slices of about
``SLICE_BYTES`` (a longer text is a slice of its own), so that temporary arrays
stay small whatever the size of an Arrow batch.  A long text takes its own size
and some 30 to 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII sign but letters and digits: words without their punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers that give each place of a window its own weight.
PLACE = [U64(x | 1) for x in np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 64, dtype=np.int64).tolist()]
#: Masks that leave the first 0 to 8 bytes of a little-endian whole number.
TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = x + U64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and UTF-8 bytes of a string column; a null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    chars = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], chars[off[0] : off[-1]]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold about ``size`` bytes, in order."""
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


class Words:
    """Words of the texts of one slice.

    ``start`` and ``end`` are byte places, ``hash`` a 64-bit hash of each word
    (exact bytes, or with A-Z lowered), ``first`` the number of the first word
    of each text (one more entry than texts).

    A word is hashed in pieces of eight bytes.  Each piece is mixed with its
    place before the pieces are summed, so that no rearrangement of a word's
    letters gives the same sum.  Bytes are looked at in runs of ``SLICE_BYTES``;
    besides these a slice holds 24 bytes a word, whatever the length of its texts.
    """

    def __init__(self, off: np.ndarray, chars: np.ndarray, lower: bool = False, blank: np.ndarray = SPACE):
        off = off - off[0]
        n = len(chars)
        opens, closes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, n, SLICE_BYTES):
            b = min(n, a + SLICE_BYTES)
            space = np.ones(b - a + 2, bool)  # with the bytes before and behind
            space[max(0, 1 - a) : b - a + 1 + (b < n)] = blank[chars[max(0, a - 1) : b + 1]]
            bounds = off[np.searchsorted(off, a) : np.searchsorted(off, b, "right")] - a
            inner = ~space[1:-1]
            begins, stops = inner & space[:-2], inner & space[2:]
            at = bounds[bounds < b - a]
            begins[at] = inner[at]
            at = bounds[bounds > 0] - 1
            stops[at] = inner[at]
            opens.append(np.flatnonzero(begins) + a)
            closes.append(np.flatnonzero(stops) + a + 1)
        self.start, self.end = np.concatenate(opens), np.concatenate(closes)
        self.first = np.searchsorted(self.start, off)
        self._chars, self._table = chars, LOWER if lower else None
        self.hash = np.zeros(len(self.start), U64)
        low = 0
        while low < len(self.start):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + SLICE_BYTES, "right")))
            self.hash[low:high] = self._hashed(self.start[low:high], self.end[low:high] - self.start[low:high])
            low = high

    def _eights(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ``size`` bytes (8 at most) from each place on as whole numbers; bytes behind these are 0."""
        low = int(at[0])
        part = self._chars[low : int(at[-1]) + 8]
        held = np.zeros(int(at[-1]) - low + 8, np.uint8)
        held[: len(part)] = part if self._table is None else self._table[part]
        found = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))[at - low]
        return found & TAIL[size]

    def _hashed(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = (length <= 8).all()
        pieces = 1 if short else (length + 7) >> 3
        if short:
            total = mix(self._eights(start, length))
        else:
            first = np.cumsum(pieces) - pieces
            number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
            at = np.repeat(start, pieces) + 8 * number
            size = np.minimum(np.repeat(length, pieces) - 8 * number, 8)
            total = np.add.reduceat(mix(self._eights(at, size) ^ (number.astype(U64) * PLACE[61])), first)
        return mix(total ^ length.astype(U64) * PLACE[63])

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of more than ``length`` bytes, and hashes of their first ``length`` bytes."""
        at = np.flatnonzero(self.end - self.start > length)
        if not len(at):
            return at, np.zeros(0, U64)
        return at, mix(self._hashed(self.start[at], np.full(len(at), length)), 500 + length)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words at which a window of ``size`` words of one text begins, and its 64-bit hash."""
        count = np.diff(self.first)
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        inside = np.ones(n, bool)
        for back in range(1, size):  # a window may not reach over the end of its text
            at = self.first[1:] - back
            at = at[(at >= self.first[:-1]) & (at < n)]
            inside[at] = False
        del count
        total = np.zeros(n, U64)
        for j in range(size):
            total += self.hash[j : j + n] * PLACE[j]
        at = np.flatnonzero(inside)
        return at, mix(total[at], seed + size)

    def owner(self) -> np.ndarray:
        """The text (by its place in the slice) of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def each_slice(column: pa.Array, lower: bool = False, blank: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first row, end row, bytes of the slice, its words) over a column."""
    off, chars = raw(column)
    for a, b in slices(off):
        part = chars[off[a] : off[b]]
        yield a, b, part, Words(off[a : b + 1], part, lower, blank)


def runs(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], keys: int = 4):
    """Calls ``work(rows)`` for each run of rows of a sorted stream that are equal in the first ``keys`` columns (whole numbers).  A run has a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            held = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
            at = 0
            for end in (np.flatnonzero((held[:, 1:] != held[:, :-1]).any(axis=0)) + 1).tolist():
                yield from work(batch.slice(at, end - at))
                at = end
            rest = batch.slice(at)
        if rest is not None:
            yield from work(rest)

    return run
