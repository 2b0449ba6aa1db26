"""Word boundaries and word fingerprints of Arrow string columns, computed on the UTF-8 bytes with NumPy.

A column is handled as one byte buffer. Word bytes never cross a document boundary. Nulls count as empty texts.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed at a time; bounds the eight-byte temporaries.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on nothing but the arguments."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _byte_class(separators: range | list[int]) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


#: Everything but ASCII white space.
SPACED = _byte_class([0x20, *range(0x09, 0x0E)])
#: ASCII letters and digits and all that is not ASCII.
ALNUM = _byte_class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_EXACT = constants(256, 1)
_FOLDED = _EXACT.copy()
_FOLDED[0x41:0x5B] = _EXACT[0x61:0x7B]
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 1024)
        up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset at which each text begins, with the end of the last one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """starts, ends: bytes of each word; base: number of the first word of each document, with the total."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    base: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.base)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.base) - 1), self.counts)

    def windows(self, width: int) -> np.ndarray:
        """Whether a window of that many words of one document starts at each word."""
        return np.repeat(self.base[1:], self.counts) - np.arange(len(self.starts)) >= width

    def text(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first] : self.ends[last - 1]].tobytes()


def split(column: pa.Array | pa.ChunkedArray, word_bytes: np.ndarray) -> Words:
    data, offsets = utf8(column)
    inside = word_bytes[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def fingerprints(words: Words, fold: bool) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes; fold: A-Z count as a-z."""
    table, out = _FOLDED if fold else _EXACT, np.empty(len(words.starts), U64)
    first = 0
    while first < len(out):
        begin = words.starts[first]
        last = max(first + 1, int(np.searchsorted(words.ends, begin + PIECE, "right")))
        sums = table[words.data[begin : words.ends[last - 1]]]
        up, down = _powers(len(sums) + 1)
        sums *= up[: len(sums)]
        np.cumsum(sums, out=sums)
        s, e = words.starts[first:last] - begin, words.ends[first:last] - begin
        own = sums[e - 1] - np.where(s > 0, sums[s - 1], U64(0))
        out[first:last] = own * down[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)
        first = last
    return mix(out)


def grams(h: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A fingerprint of each run of that many words; only full runs get one."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, U64)
    for k, c in enumerate(constants(width, seed)):
        out += h[k : k + n] * c
    return mix(out)


def spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(marks: np.ndarray, width: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the windows that begin at the words `marks`."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, marks, 1)
    np.add.at(steps, marks + width, -1)
    return np.cumsum(steps[:-1]) > 0


def pieces(batches, columns: tuple[str, ...] = ("text",), limit: int = 4 << 20):
    """The rows of the batches in slices of at most about `limit` bytes of text, or of one row."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        part = (np.cumsum(size) - size) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
            yield batch.slice(int(a), int(b - a))
