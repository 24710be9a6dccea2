"""Vectorised word handling over Arrow string arrays.

Texts are treated as UTF-8 bytes.  All separators used here are ASCII, so byte-wise
classification never cuts a multi-byte character.  Everything works on chunks of about
``CHUNK_BYTES`` of text so that peak memory does not depend on batch or corpus size (one
text longer than that forms a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of words [^\x20\x09-\x0D]+
PLAIN = ~_WS
#: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z, everything beyond ASCII)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: bytes that start a code point
LEAD = (np.arange(256) & 0xC0) != 0x80

#: hashes are polynomials modulo this prime; modulo 2**64 some texts collide whatever the base is
_PRIME = (1 << 61) - 1
_P = U64(_PRIME)
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BASES = tuple(int(x) for x in _rng.integers(2**60, _PRIME - 1, 3, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo the prime, of numbers below it, by halves of 30 and 31 bits."""
    low = U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(U64(2) * (a1 * b1) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31)) + a0 * b0)


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, _PRIME)):
            t = np.ones(size, dtype=np.uint64)
            filled = 1
            while filled < size:
                t[filled : 2 * filled] = _product(t[:filled], U64(pow(base, filled, _PRIME)))
                filled *= 2
            tables.append(t)
        have = _powers[which] = (tables[0], tables[1])
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Spans:
    """Hashes of slices of an array of bytes or of 64-bit numbers; equal slices get equal hashes at any position."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        power, self.inverse = _power_tables(which, n + 1)
        self.bits = 31 if n < 1 << 23 or values.dtype != np.uint8 else 21  # sums of parts of terms stay below 2**64
        mask, shifts = U64((1 << self.bits) - 1), range(0, 62, self.bits)
        self.prefixes = [np.zeros(n + 1, dtype=np.uint64) for _ in shifts]
        for lo in range(0, n, 1 << 15):  # what lies in the cache at once
            hi = min(n, lo + (1 << 15))
            if values.dtype == np.uint8:
                terms = values[lo:hi].astype(np.uint64) + U64(1)
                parts = [terms * ((power[lo:hi] >> U64(shift)) & mask) for shift in shifts]
            else:
                terms = _product(_reduced(values[lo:hi]), power[lo:hi])
                parts = [(terms >> U64(shift)) & mask for shift in shifts]
            for prefix, part in zip(self.prefixes, parts, strict=True):
                part[0] += prefix[lo]
                np.cumsum(part, out=prefix[lo + 1 : hi + 1])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts, ends = np.asarray(starts), np.asarray(ends)
        total = np.zeros(len(starts), dtype=np.uint64)
        for k, prefix in enumerate(self.prefixes):
            part = _reduced(prefix[ends] - prefix[starts])
            total = _reduced(total + (_product(part, U64(1 << k * self.bits)) if k else part))
        lengths = (ends - starts).astype(np.uint64)
        return mix64(_product(total, self.inverse[starts]) + lengths * U64(0x9E3779B97F4A7C15))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each values[start:end]."""
    return Spans(values, which)(starts, ends)


class Chunk:
    """Some consecutive texts of a batch, cut into words.

    first, stop: rows of the batch; data: their bytes; text_at: byte offset of each text
    (one more than texts); start, end: byte range of each word; word_at: number of the
    first word of each text (one more than texts).
    """

    __slots__ = ("first", "stop", "data", "text_at", "start", "end", "word_at")

    def __init__(self, first: int, stop: int, data: np.ndarray, text_at: np.ndarray, is_word: np.ndarray):
        self.first, self.stop, self.data, self.text_at = first, stop, data, text_at
        inside = is_word[data]
        starts, ends = inside.copy(), inside
        if len(data):
            before = inside[:-1].copy()
            starts[1:] &= ~before
            at = text_at[:-1]
            at = at[at < len(data)]
            starts[at] = is_word[data[at]]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            last = text_at[1:] - 1
            last = last[last >= 0]
            ends[last] = is_word[data[last]]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.word_at = np.searchsorted(self.start, text_at)

    def __len__(self) -> int:
        return self.stop - self.first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hash(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def room(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its text."""
        return np.repeat(self.word_at[1:], self.counts()) - np.arange(len(self.start))


def window_hash(word_hashes: np.ndarray, first: np.ndarray, k: np.ndarray | int, which: int = 1) -> np.ndarray:
    """Hash of the k words from each position in ``first``."""
    return span_hash(word_hashes, first, first + k, which)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, is_word: np.ndarray = PLAIN, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut the texts of a column into chunks of about ``size`` bytes, whole texts each."""
    raw, at = text_buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        stop = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        stop = min(n, max(first + 1, stop))
        data = raw[at[first] : at[stop]]
        yield Chunk(first, stop, _LOWER[data] if lower else data, at[first : stop + 1] - at[first], is_word)
        first = stop


def laid_words(c: Chunk) -> tuple[bytes, np.ndarray]:
    """The words of a chunk with one space after each, and where each starts (one more than words)."""
    size = c.end - c.start
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=at[1:])
    laid = np.full(at[-1], 0x20, dtype=np.uint8)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[1:] - 1] = False
    laid[inside] = c.data[(np.repeat(c.start - at[:-1], size + 1) + np.arange(at[-1]))[inside]]
    return laid.tobytes(), at


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
