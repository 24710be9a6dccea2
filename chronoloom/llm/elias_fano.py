"""Elias-Fano coding of non-decreasing integer sequences, with select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQIIQQ")  # values, largest value, low bits, select step, bytes of lows, bytes of highs
SELECT_STEP = 512


def _pack(values: np.ndarray, bits: int) -> bytes:
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values, so blocks end on whole bytes
        block = values[at : at + (1 << 16), None] >> np.arange(bits, dtype=np.uint64)
        out.append(np.packbits((block & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def encode(values: np.ndarray) -> bytes:
    """values: unsigned 64-bit, non-decreasing."""
    values = np.asarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    lows = _pack(values & np.uint64((1 << low_bits) - 1), low_bits) if low_bits else b""
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    highs = np.zeros((int(ones[-1]) // 8 + 1) * 8 if n else 0, dtype=np.uint8)
    highs[ones] = 1
    highs = np.packbits(highs, bitorder="little").tobytes()
    samples = ones[::SELECT_STEP].astype("<u8").tobytes()
    return _HEAD.pack(n, top, low_bits, SELECT_STEP, len(lows), len(highs)) + samples + lows + highs


class EliasFano:
    """A view of encoded bytes: ``select`` reads one value, ``values`` some in a row, ``decode`` all."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.top, self.low_bits, self.step, n_low, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.samples = np.frombuffer(data, dtype="<u8", count=-(-self.n // self.step), offset=at)
        at += self.samples.nbytes
        self.lows = np.frombuffer(data, dtype=np.uint8, count=n_low, offset=at)
        self.highs = np.frombuffer(data, dtype=np.uint8, count=n_high, offset=at + n_low)
        self.nbytes = at + n_low + n_high

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.lows[first // 8 : -(-last // 8)].tobytes(), "little")
        return part >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled position on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rank = int(self.samples[i // self.step]), i % self.step
        byte, skip = at // 8, at % 8
        word = int(self.highs[byte]) >> skip << skip
        while word.bit_count() <= rank:
            rank -= word.bit_count()
            byte += 1
            word = int(self.highs[byte])
        for _ in range(rank):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def values(self, first: int, stop: int) -> np.ndarray:
        """Values first to stop - 1: a select to the nearest sampled position, and the bits from there on."""
        if not 0 <= first <= stop <= self.n:
            raise IndexError((first, stop))
        if first == stop:
            return np.zeros(0, dtype=np.uint64)
        start, after = int(self.samples[first // self.step]), -(-stop // self.step)
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[start // 8 : end // 8 + 1], bitorder="little")) + start // 8 * 8
        ones = ones[np.searchsorted(ones, start) + first % self.step :][: stop - first]
        high = (ones - np.arange(first, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        skip = first * self.low_bits % 8
        bits = np.unpackbits(self.lows[first * self.low_bits // 8 : -(-stop * self.low_bits // 8)], bitorder="little")
        bits = bits[skip : skip + (stop - first) * self.low_bits].reshape(stop - first, self.low_bits)
        low = np.zeros(stop - first, dtype=np.uint64)
        for b in range(self.low_bits):
            low |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return high | low

    def decode(self) -> np.ndarray:
        return self.values(0, self.n)
