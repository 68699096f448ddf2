"""Vectorised words and rolling hashes over batches of UTF-8 texts.

Every delimiter of the word classes used here is ASCII, so cutting the UTF-8
bytes gives exactly the words that cutting code points would give.  A word's hash
chains a bijective finaliser over its blocks of eight bytes, so no regular
structure in words collides.  Ranges of words or bytes have polynomial hashes in
uint64 arithmetic, followed by a finaliser; such a hash tells apart all content but
that of some thousand values made of two values by doubling (Thue-Morse), and
ranges here are shorter (at most 352 bytes or 88 words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words of more bytes are digested one by one.
LONG_WORD = 256
#: Texts of one chunk hold at most so many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 256 << 10

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _bases(seed: int) -> tuple[int, int]:
    base = (int(mix(np.array([seed * 2654435761 + 97], _U))[0]) & ~7) | 5
    return base, pow(base, -1, 1 << 64)


class Rolling:
    """Hashes of ranges of a sequence of uint64 values, in O(1) each."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, seed: int = 1):
        n = len(values) + 1
        up, down = self._powers.get(seed, (np.empty(0, _U), np.empty(0, _U)))
        if len(up) < n:
            base, inverse = _bases(seed)
            size = max(n, 1 << 16)
            up, down = np.full(size, base, _U), np.full(size, inverse, _U)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
            if size <= 8 * CHUNK_BYTES:
                self._powers[seed] = up, down
        self.down = down
        self.sums = np.zeros(n, _U)
        np.cumsum(values * up[: n - 1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], elementwise; equal content gives equal hashes."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

    def grams(self, n: int) -> np.ndarray:
        """Hash of every run of n values."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.empty(0, _U)


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U)

SPACE, ALNUM = "space", "alnum"
_WORD_BYTES = {
    # [^\x20\x09-\x0D]
    SPACE: np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)]),
    # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
    ALNUM: np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)]),
}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, one after the other, and len + 1 offsets; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of a batch: bytes [start, end) of data; those of text i are first[i] to first[i + 1]."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], elementwise, by blocks of eight bytes; equal bytes give equal hashes."""
    size = end - start
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", whole, strides=(1,))  # the eight bytes from every place
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(97))
    short = np.flatnonzero(size <= LONG_WORD)
    at, left, k = start[short], size[short], short
    while len(k):
        out[k] = mix(out[k] ^ (blocks[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        k, at, left = k[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(texts: pa.Array, kind: str = SPACE, lower: bool = True) -> Words:
    data, at = text_bytes(texts)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD_BYTES[kind].take(data)
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    opens[edges] |= inside[edges]
    closes = inside[:-1] & ~inside[1:]
    closes[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, at, start, end, np.searchsorted(start, at), word_hashes(_LOWER.take(data) if lower else data, start, end))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES.take(data)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold at most `most` bytes, or one row; of at most `rows` rows."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, i + rows, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in every `width` consecutive ones; of equal ones the rightmost.

    Values are compared by their upper 32 bits, with the position below them,
    so equal content picks the same relative position wherever it stands.
    Blocks of `width` with running minima from both ends make the cost
    independent of the width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = _U(0xFFFFFFFF)
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, _U)
    blocks[: len(values)] = (values & ~low) | (low - np.arange(len(values), dtype=_U))
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (low - (least & low)).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """arange(start, start + length) for each pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Lookup:
    """Place of each of many 64-bit keys in a fixed list of distinct keys, or -1: open addressing, probed for all at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, _U(0))
        self.mask = _U((1 << max(4, (len(keys) * 3).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, len(keys), np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), keys & self.mask
        while len(todo):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = todo[free]  # of several at one slot, the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + _U(1)) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        none = len(self.keys) - 1
        at = wanted & self.mask
        out = self.slots.take(at.astype(np.int64))
        todo = np.flatnonzero((self.keys.take(out) != wanted) & (out != none))
        while len(todo):
            at[todo] = (at[todo] + _U(1)) & self.mask
            found = self.slots[at[todo]]
            out[todo] = found
            todo = todo[(self.keys[found] != wanted[todo]) & (found != none)]
        return np.where(out == none, -1, out)


class Places:
    """Numbers 0, 1, ... for 64-bit hashes in the order they are added: open addressing that grows, 16 to 28 bytes a hash."""

    def __init__(self):
        self.n, self.keys, self.slots = 0, np.empty(1 << 12, _U), np.full(1 << 14, -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        mask = np.int64(len(self.slots) - 1)
        out = np.full(len(wanted), -1, np.int64)
        todo, at = np.arange(len(wanted)), wanted.view(np.int64) & mask
        while len(todo):
            found = self.slots[at]
            out[todo] = np.where((found >= 0) & (self.keys[found] == wanted[todo]), found, -1)
            left = (found >= 0) & (out[todo] < 0)
            todo, at = todo[left], (at[left] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct hashes that have no number yet."""
        first, self.n = self.n, self.n + len(keys)
        if self.n > len(self.keys):
            self.keys = np.concatenate([self.keys[:first], np.empty(max(self.n, len(self.keys) * 3 // 2) - first, _U)])
        self.keys[first : self.n] = keys
        if self.n > len(self.slots) // 2:
            first, self.slots = 0, np.full(1 << (self.n * 2).bit_length(), -1, np.int32)
        mask = np.int64(len(self.slots) - 1)
        todo = np.arange(first, self.n, dtype=np.int32)
        at = self.keys[first : self.n].view(np.int64) & mask
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several at one slot, the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & mask
