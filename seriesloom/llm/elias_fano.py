"""Elias-Fano code of a non-decreasing sequence: low bits packed, high bits unary, and samples for select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: Values whose low bits are packed at once; a multiple of 8.
SLICE = 1 << 14
_HEAD = struct.Struct("<QQBxxxI")


def encode(values: np.ndarray) -> bytes:
    """Bytes for non-decreasing values >= 0: about 2 + log2(largest / n) bits each."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    # in slices whose bits fill whole bytes
    lows = b"".join(_low_bits(values[i : i + SLICE], low) for i in range(0, n, SLICE)) if low else b""
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(n + (top >> low) + 1, np.uint8)
    high[ones] = 1
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    packed = np.packbits(high, bitorder="little").tobytes()
    return _HEAD.pack(n, top, low, len(packed)) + samples + packed + lows


def _low_bits(values: np.ndarray, low: int) -> bytes:
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """Reads encode()'s bytes: select(i) gives value i by itself, slice(i, j) a run of them; no table of 64-bit values is kept."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low, size = _HEAD.unpack_from(data)
        at = _HEAD.size
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", count, at)
        self.high = np.frombuffer(data, np.uint8, size, at + 4 * count)
        self.lows = np.frombuffer(data, np.uint8, -1, at + 4 * count + size)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i..j-1."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        k = i // SAMPLE
        begin = int(self.samples[k]) // 8
        k2 = -(-j // SAMPLE)
        end = int(self.samples[k2]) // 8 + 1 if k2 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        ones = ones[ones >= self.samples[k]][i - k * SAMPLE : j - k * SAMPLE]
        out = (ones - np.arange(i, j)) << self.low
        if self.low:
            a, b = i * self.low, j * self.low
            bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a]
            out += bits.reshape(-1, self.low).astype(np.int64) @ (1 << np.arange(self.low))
        return out
