"""Words of many texts as arrays: positions, hashes, and hashes of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_CHAR = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD1342543DE82EF95)
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts hold about SLICE_BYTES, at least a row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        begin, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    key = int(base)
    if key not in _cache or len(_cache[key][0]) < n:
        n = max(n, 1 << 20)
        inverse = pow(key, -1, 2**64)
        made = []
        for factor in (key, inverse):
            row = np.full(n, factor, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _cache[key] = (made[0], made[1])
    return _cache[key]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sequences:
    """Hashes of any stretch of a row of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        powers, self.inverse = _powers(base, len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.prefix[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


class Words:
    """The words of ``texts``, one after the other.

    starts, ends: where each word lies in ``data``; text: the number of its text;
    hashes: a 64-bit hash of each word; first: the first word of each text, and the
    number of all words.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        byte = np.frombuffer(self.data, np.uint8)
        space = _SPACE[byte]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.cumsum(sizes) - sizes
        self.first = np.append(np.searchsorted(self.starts, begins), len(self.starts))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = np.empty(len(self.starts), np.uint64)
        low = 0
        while low < len(self.starts):
            begin = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, "right")))
            letters = Sequences(_TABLE[byte[begin : self.ends[high - 1]]], _CHAR)
            own = slice(low, high)
            self.hashes[own] = letters.hash(self.starts[own] - begin, self.ends[own] - begin)
            low = high

    def sequences(self) -> Sequences:
        return Sequences(self.hashes, _WORD)
