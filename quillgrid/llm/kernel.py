"""Vectorised text kernels shared by the numpy-backed operators.

Every kernel works on whole Arrow batches: the UTF-8 buffer of a string column is
viewed as one numpy byte array, and words, hashes and n-grams of all its rows are
found together.  Nothing here looks at a row at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the SplitMix64 generator: a bijection on 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """MULT**i and MULT**-i modulo 2**64, grown as longer buffers come."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(MULT, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INV, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word's number of each row (rows + 1).

    ``breaks`` marks bytes that are in no word; a row's end also ends a word.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~breaks[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = inside[1:-1][inner]
    last[inner - 1] = inside[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]]: a polynomial by prefix sums, then mixed. Spans ascend and don't overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + block, side="right")), i + 1)
        hi = ends[j - 1]
        up, down = _POWERS.upto(int(hi - lo) + 1)
        sums = np.zeros(int(hi - lo) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data[lo:hi]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = splitmix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes (len(h) - n + 1 of them); rows must be told apart by the caller."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out *= np.uint64(MULT)
        out += h[i : i + m]
    return splitmix(out)


class Table:
    """Values by 64-bit keys that are spread evenly (hashes): sorted, with an index on their leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        keys = np.asarray(keys).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = [np.asarray(v)[order] for v in values]
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        asked = asked.view(np.uint64)
        slot = asked >> self.shift
        at, end = self.first[slot], self.first[slot + np.uint64(1)]
        out = np.full(len(asked), -1, dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = self.keys[at[left]] == asked[left]
            out[left[here]] = at[left[here]]
            left = left[~here]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


#: Bytes of text that are worked on at once: temporary arrays are some twenty times as large.
SLICE = 1 << 20


def batches(batch: pa.RecordBatch, column: str, most: int = SLICE):
    """Slices of a batch whose ``column`` holds about ``most`` bytes at the most (or one text), so that memory stays bounded."""
    _, off = buffer_of(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(int(np.searchsorted(off, off[i] + most, side="right")) - 1, i + 1)
        yield batch.slice(i, j - i)
        i = j
