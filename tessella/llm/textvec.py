"""Words of Arrow text columns as 64-bit hashes, by array operations over the UTF-8 bytes.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased. Its hash takes eight bytes at a time, each
mixed by a bijection without linear structure, from a state made of the length; long words are hashed by xxhash. Words
of up to eight bytes and equal length never collide, other two different words with a chance near 2^-64. Where a wrong
answer would come of a collision, Table compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text that are taken at a time; one longer text is taken whole.
CHUNK = 1 << 20
#: Bytes of a span from which on it is hashed and compared by itself.
LONG = 128

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
_SEED = 0x243F6A8885A308D3


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads their bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets into them; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows within limit bytes, a longer row by itself."""
    raw, offs = buffers(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(raw: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none goes over the end of a row."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~breaks[raw]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(last) + 1


def padded(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """raw with eight more bytes, so that eight can be read from any place."""
    out = np.zeros(len(raw) + 8, np.uint8)
    if lower:
        np.take(_LOWER, raw, out=out[: len(raw)])
    else:
        out[: len(raw)] = raw
    return out


def _eight(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes from each place on as one number: eight, or as many as are left."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at] & _MASK[np.minimum(left, 8)]


def hash_padded(padded: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of padded bytes."""
    with np.errstate(over="ignore"):
        h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(_SEED))
        h = mix((h ^ _eight(padded, starts, size)) * U(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : starts[i] + size[i]], seed=_SEED)
        rest, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            left = size[rest] - at
            h[rest] = mix((h[rest] ^ _eight(padded, starts[rest] + at, left)) * U(0x9E3779B97F4A7C15))
            rest, at = rest[left > 8], at + 8
    return h


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each span of bytes."""
    return hash_padded(padded(raw, lower), starts, ends - starts)


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of a and b are equal from each pair of starts on. a and b are padded."""
    out = _eight(a, a_starts, length) == _eight(b, b_starts, length)
    for i in np.flatnonzero(out & (length > LONG)).tolist():
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + length[i]], b[b_starts[i] : b_starts[i] + length[i]])
    rest, at = np.flatnonzero(out & (length > 8) & (length <= LONG)), 8
    while len(rest):
        left = length[rest] - at
        out[rest] = _eight(a, a_starts[rest] + at, left) == _eight(b, b_starts[rest] + at, left)
        rest, at = rest[out[rest] & (left > 8)], at + 8
    return out


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, row bounds): words of row i are those from bounds[i] to bounds[i + 1]."""
    starts, ends = spans(raw, offs)
    return hash_spans(raw, starts, ends), starts, ends, np.searchsorted(starts, offs)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place on; the last n - 1 places run over the end and must be left out."""
    out = h.copy()
    m = len(h)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out[: m - k] = mix(out[: m - k] * U(0x9E3779B97F4A7C15) + h[k:])
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each word its row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class Pool:
    """Values one after another in an array that grows by doubling."""

    def __init__(self, dtype: type) -> None:
        self.values, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, flat: np.ndarray) -> int:
        """Append values; where they begin. Eight values more than used are always there."""
        if self.used + len(flat) + 8 > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(max(len(self.values), len(flat) + 8), self.values.dtype)])
        self.values[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)


class Table:
    """A direct-mapped cache from spans of bytes to runs of 32-bit values: bounded, and looked up by arrays.

    Entries are found by a hash and then compared byte by byte, so that a collision costs time and no more.
    """

    def __init__(self, bits: int = 19, limit: int = 1 << 21) -> None:
        self.bits, self.limit = bits, limit
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys, self.start, self.length, self.at, self.size = (np.zeros(size, t) for t in (U, *[np.int32] * 4))
        self.size[:] = -1
        self.runs, self.spelt = Pool(np.uint32), Pool(np.uint8)

    @property
    def pool(self) -> np.ndarray:
        return self.runs.values

    def _put(self, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.runs.add(flat) + np.cumsum(length) - length, length

    def get(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in the pool for each span of raw, of hash h; make(indexes) gives the runs of those that aren't
        there, one after another, and their lengths.

        A hash may depend on more than the bytes, if spans of equal bytes with other hashes are to have runs of their own."""
        if max(self.runs.used, self.spelt.used // 4) > self.limit:
            self.clear()
        room, size = padded(raw), ends - starts
        slot = (h & U(len(self.keys) - 1)).astype(np.int64)
        start, length = self.start[slot].astype(np.int64), self.length[slot].astype(np.int64)
        there = (self.keys[slot] == h) & (self.size[slot] == size)
        seen = np.flatnonzero(there)
        there[seen] = equal_spans(room, starts[seen], self.spelt.values, self.at[slot[seen]].astype(np.int64), size[seen])
        miss = np.flatnonzero(~there)
        if len(miss):
            unique, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            model = miss[first]
            at, n = self._put(*make(model))
            start[miss], length[miss] = at[inverse], n[inverse]
            like = model[inverse]
            same = size[miss] == size[like]
            same[same] = equal_spans(room, starts[miss[same]], room, starts[like[same]], size[miss[same]])
            odd = miss[~same]
            if len(odd):  # spans that share a hash with another one of this call
                start[odd], length[odd] = self._put(*make(odd))
            spelt = self.spelt.add(gather(raw, starts[model], size[model])) + np.cumsum(size[model]) - size[model]
            slot = (unique & U(len(self.keys) - 1)).astype(np.int64)
            # Where several new hashes share a slot, all arrays keep the last one's values.
            self.keys[slot], self.start[slot], self.length[slot], self.at[slot], self.size[slot] = unique, at, n, spelt, size[model]
        return start, length


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of a pool, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - length), length) + np.arange(total)]
