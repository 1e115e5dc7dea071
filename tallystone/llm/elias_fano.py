"""Elias-Fano coding of non-decreasing integers, with select by sampled ranks."""

from __future__ import annotations

import numpy as np

#: Bits of the upper part for each sampled rank (a 32-bit count).
SAMPLE_BITS = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, least significant first."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    """The values at these positions of a packed array."""
    if not width:
        return np.zeros(len(index), np.int64)
    at = index.astype(np.int64)[:, None] * width + np.arange(width)
    bits = (data[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (bits.astype(np.int64) << np.arange(width)).sum(1)


def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low width, low bits, upper bits (unary), sampled ranks of a non-decreasing array that starts at 0."""
    n = len(values)
    most = int(values[-1]) if n else 0
    width = max(0, (most // n).bit_length() - 1) if n else 0
    upper = (values >> width) + np.arange(n)
    bits = np.zeros(-(-(int(upper[-1]) + 1 if n else 0) // SAMPLE_BITS) * SAMPLE_BITS, np.uint8)
    bits[upper] = 1
    ones = bits.reshape(-1, SAMPLE_BITS).sum(1)
    samples = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
    return width, pack(values & ((1 << width) - 1), width), np.packbits(bits, bitorder="little").tobytes(), samples.tobytes()


class Offsets:
    """select(i): the i-th value, from the coded parts alone."""

    def __init__(self, width: int, low: bytes, upper: bytes, samples: bytes):
        self.width = width
        self.low, self.upper = np.frombuffer(low, np.uint8), np.frombuffer(upper, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    def select(self, index) -> np.ndarray:
        index = np.atleast_1d(np.asarray(index, np.int64))
        block = np.searchsorted(self.samples, index, "right") - 1
        rest = index - self.samples[block]
        words = self.upper.reshape(-1, SAMPLE_BITS // 8)[block]
        counts = np.cumsum(_POPCOUNT[words], 1, dtype=np.int64)
        byte = (counts <= rest[:, None]).sum(1)
        rows = np.arange(len(index))
        rest = rest - np.where(byte > 0, counts[rows, np.maximum(byte - 1, 0)], 0)
        bits = np.unpackbits(words[rows, byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, 1) <= rest[:, None]).sum(1)
        return (((block * SAMPLE_BITS + byte * 8 + bit) - index) << self.width) | unpack(self.low, self.width, index)
