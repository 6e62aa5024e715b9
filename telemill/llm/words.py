"""64-bit hashes of all words of many texts at once, in numpy over Arrow's own buffers.

A word's hash is the sum of a random 64-bit value per byte times a power of an odd base, finished by a
mixing step; sums over stretches of bytes come from one cumulative sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 19  # bytes hashed at once; bounds memory for very long texts
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes lower-cased as ASCII does.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_on(separators: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: Words end at ASCII white space.
NON_SPACE = split_on(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters, digits and all bytes beyond ASCII.
ALPHANUMERIC = split_on(bytes(b for b in range(128) if not chr(b).isalnum()))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_batches(batch: pa.RecordBatch, most: int = SEGMENT, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of some texts: ``start`` and ``end`` (bytes), ``first`` (index of each text's first word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = NON_SPACE):
        self.data = LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = in_word[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | begins[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | begins[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """Hashes of the whole words, then of their first ``k`` bytes for every ``k`` of ``prefixes``."""
        out = [np.zeros(len(self.start), dtype=np.uint64) for _ in range(1 + len(prefixes))]
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + SEGMENT, side="right")))
            piece = self.data[low : self.end[to - 1]]
            power, inverse = _powers(len(piece))
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[piece] * power[: len(piece)], out=sums[1:])
            start, end = self.start[at:to] - low, self.end[at:to] - low
            for k, found in zip((None, *prefixes), out, strict=True):
                stop = end if k is None else np.minimum(end, start + k)
                found[at:to] = mixed((sums[stop] - sums[start]) * inverse[start])
            at = to
        return out


_kept: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_kept[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            powers = np.full(max(n, SEGMENT), base, dtype=np.uint64)
            powers[0] = 1
            _kept[k] = np.cumprod(powers, dtype=np.uint64)
    return _kept


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words of one text; of the whole text when it has fewer, but at least one."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    total = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mixed(total * _BASE + hashes[k : len(hashes) - width + 1 + k])
    return total
