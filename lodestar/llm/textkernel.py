"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Texts are never turned into Python strings here: a column is one byte array plus offsets, and words,
their hashes and their documents are numpy arrays.  Everything runs in pieces of about PIECE bytes, cut
between words where words matter, so temporaries stay small whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII capitals to small letters, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PLUS_ONE = np.arange(1, 257, dtype=np.uint64)
_LOWER_PLUS_ONE = LOWER.astype(np.uint64) + np.uint64(1)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
WHITESPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, letters and all beyond ASCII.
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a finaliser of the xor-shift-multiply family)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, PIECE + PIECE // 4)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = tuple(tables)
    return _powers


def _cuts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE bytes that end where no word goes on."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + PIECE)
        while end < n and not gap[data[end]]:
            k = int(np.searchsorted(offsets, end))
            if offsets[k] == end:
                break
            ahead = np.flatnonzero(gap[data[end : min(int(offsets[k]), end + PIECE)]])
            end = end + int(ahead[0]) if len(ahead) else min(int(offsets[k]), end + PIECE)
        yield start, end
        start = end


def document_blocks(offsets: np.ndarray, size: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes in all; a longer document is one of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a column: byte ranges, hash and document of each, in order; first[d] is the first word of document d."""

    __slots__ = ("doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, start, end, hash_, offsets):
        self.start, self.end, self.hash = start, end, hash_
        self.n_docs = len(offsets) - 1
        self.first = np.searchsorted(start, offsets, side="left")
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Splits every document into words; equal words (after lower-casing A-Z) have equal 64-bit hashes."""
    n = len(data)
    value = _LOWER_PLUS_ONE if lower else _PLUS_ONE
    inside_of = ~(separator[LOWER] if lower else separator)
    breaks = offsets[(offsets > 0) & (offsets < n)]
    starts, ends, hashes = [], [], []
    for a, b in _cuts(data, offsets, ~inside_of):
        inside = inside_of[data[a:b]].view(np.int8)
        edge = np.empty(b - a + 1, np.int8)
        edge[0], edge[-1] = inside[0], -inside[-1]
        np.subtract(inside[1:], inside[:-1], out=edge[1:-1])
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A document that starts inside a run of word bytes ends one word and starts another.
        cut = breaks[np.searchsorted(breaks, a + 1) : np.searchsorted(breaks, b)] - a
        cut = np.unique(cut[(inside[cut] == 1) & (inside[cut - 1] == 1)])
        if len(cut):
            s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
        starts.append(s + a)
        ends.append(e + a)
        if hashed:
            power, inverse = _power_tables(b - a + 1)
            total = np.empty(b - a + 1, np.uint64)
            total[0] = 0
            terms = value[data[a:b]]
            terms *= power[: b - a]
            np.cumsum(terms, out=total[1:])
            h = (total[e] - total[s]) * inverse[s]
            h += (e - s).astype(np.uint64) << np.uint64(56)
            hashes.append(mix(h))
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Words(cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64) if hashed else None, offsets)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values; entry i is the run that starts at i (the last n-1 have none)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[k : k + m]
    return mix(out)


def windows(first: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words at which a run of n words of one document starts."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(first[:-1], counts)


_SPREAD = np.zeros(256, np.uint64)
for _bit in range(8):
    _SPREAD += ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group hashes[first[g]:first[g+1]], the 64-bit value whose bits are set in over half of the group's hashes.

    Bits are counted eight to a 64-bit word, in segments of at most 255 hashes, so nothing overflows.
    """
    sizes = np.diff(first)
    groups = len(sizes)
    out = np.zeros(groups, np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    pieces = (sizes[some] + 254) // 255
    owner = np.repeat(np.arange(len(some)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][some][owner] + 255 * rank
    own = np.cumsum(pieces) - pieces
    base = int(first[0])
    used = hashes[base : int(first[-1])]
    starts = starts - base
    for byte in range(8):
        lane = _SPREAD[((used >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.uint8)]
        sums = np.add.reduceat(lane, starts)
        counts = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, own, axis=0)
        on = counts * 2 > sizes[some][:, None]
        bits = (on.astype(np.uint64) << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64)
        out[some] |= bits << np.uint64(8 * byte)
    return out
