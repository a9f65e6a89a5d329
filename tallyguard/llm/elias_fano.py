"""Elias-Fano code of a rising list of integers, with select.

A list of m values below u is kept in about m * (2 + log2(u / m)) bits: the low bits of each
value lie side by side, the high bits are a bit vector in which the one of value i is at
position (value >> low bits) + i. Sampled positions of ones make ``get`` a short scan.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEADER = struct.Struct("<QQBxxxxxxx")
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """The code of unsigned 64-bit values that never fall."""
    values = np.asarray(values, dtype=np.uint64)
    count = len(values)
    most = int(values[-1]) if count else 0
    low = max(0, (most // max(count, 1)).bit_length() - 1)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(count)
    high = np.zeros(int(ones[-1]) + 1 if count else 0, dtype=np.uint8)
    high[ones] = 1
    shifts = np.arange(low, dtype=np.uint64)
    lows = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return (
        _HEADER.pack(count, most, low)
        + _pack(lows.ravel())
        + ones[::SAMPLE].astype("<u8").tobytes()
        + _pack(high)
    )


class RisingList:
    """Reads the code at the start of ``data``; ``size`` is the number of bytes it takes."""

    def __init__(self, data: bytes):
        self.count, most, self.low = _HEADER.unpack_from(data)
        at = _HEADER.size
        end = at + (self.count * self.low + 7) // 8
        self._lows = np.frombuffer(data, np.uint8, end - at, at)
        samples = -(-self.count // SAMPLE)
        self._samples = np.frombuffer(data, "<u8", samples, end)
        at = end + 8 * samples
        ones = (most >> self.low) + self.count if self.count else 0
        self._high = np.frombuffer(data, np.uint8, (ones + 7) // 8, at)
        self.size = at + len(self._high)

    def _select(self, i: int) -> int:
        """Position of the one of value i."""
        position = int(self._samples[i // SAMPLE])
        left = i % SAMPLE
        byte = position // 8
        part = int(self._high[byte]) & (0xFF << position % 8)
        while left >= _ONES[part]:
            left -= int(_ONES[part])
            byte += 1
            part = int(self._high[byte])
        for _ in range(left):
            part &= part - 1
        return 8 * byte + (part & -part).bit_length() - 1

    def get(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = self._select(i) - i
        for k in range(self.low):
            bit = i * self.low + self.low - 1 - k
            value = value << 1 | (int(self._lows[bit // 8]) >> bit % 8 & 1)
        return value

    def all(self) -> np.ndarray:
        """All values, as unsigned 64-bit numbers."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.count]
        values = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self._lows, bitorder="little")[: self.count * self.low]
            weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
            values += (bits.reshape(self.count, self.low) * weights).sum(axis=1, dtype=np.uint64)
        return values
