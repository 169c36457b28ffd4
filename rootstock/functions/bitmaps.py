"""Compressed bitmaps over ordinals, and counters and sums held as bit slices of them.

A bitmap is a sorted array of ordinals where it is sparse and packed bits where it is dense.  Number x
of ordinal o is spread over slices: o is in slice k where bit k of x is set.  Two sliced vectors are
added as a ripple-carry adder does it, by XOR, AND and OR of whole bitmaps.
"""

from __future__ import annotations

import struct

import numpy as np

#: An array of 4-byte ordinals is smaller than packed bits below one ordinal in 32.
_DENSE = 32


class Bitmap:
    """Immutable set of ordinals below `size`."""

    __slots__ = ("array", "bits", "size")

    def __init__(self, size: int, array: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.size, self.array, self.bits = size, array, bits

    @classmethod
    def of(cls, ordinals: np.ndarray, size: int) -> Bitmap:
        """From sorted distinct ordinals."""
        if len(ordinals) * _DENSE < size:
            return cls(size, array=ordinals.astype(np.uint32))
        flags = np.zeros(size, np.uint8)
        flags[ordinals] = 1
        return cls(size, bits=np.packbits(flags))

    def ordinals(self) -> np.ndarray:
        if self.array is not None:
            return self.array
        return np.flatnonzero(np.unpackbits(self.bits, count=self.size)).astype(np.uint32)

    def _packed(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(self.size, np.uint8)
        flags[self.array] = 1
        return np.packbits(flags)

    def __bool__(self) -> bool:
        return len(self.array) > 0 if self.array is not None else bool(self.bits.any())

    def _op(self, other: Bitmap, arrays, words) -> Bitmap:
        if self.array is not None and other.array is not None:
            return Bitmap.of(arrays(self.array, other.array), self.size)
        bits = words(self._packed(), other._packed())
        if int(np.bitwise_count(bits).sum()) * _DENSE < self.size:
            return Bitmap(self.size, array=Bitmap(self.size, bits=bits).ordinals())
        return Bitmap(self.size, bits=bits)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._op(other, lambda a, b: np.intersect1d(a, b, assume_unique=True), np.bitwise_and)

    def __or__(self, other: Bitmap) -> Bitmap:
        return self._op(other, np.union1d, np.bitwise_or)

    def __xor__(self, other: Bitmap) -> Bitmap:
        return self._op(other, lambda a, b: np.setxor1d(a, b, assume_unique=True), np.bitwise_xor)

    def moved(self, to: np.ndarray, size: int) -> Bitmap:
        """The same entities under new ordinals; `to` is increasing."""
        return Bitmap.of(to[self.ordinals()], size)


def slices(ordinals: np.ndarray, numbers: np.ndarray, size: int) -> list[Bitmap]:
    """Slices of non-negative int64 numbers at sorted distinct ordinals."""
    width = int(numbers.max()).bit_length() if len(numbers) else 0
    return [Bitmap.of(ordinals[(numbers >> k) & 1 == 1], size) for k in range(width)]


def add(a: list[Bitmap], b: list[Bitmap]) -> list[Bitmap]:
    """Sum of two sliced vectors over the same ordinals, by carry addition."""
    if not a or not b:
        return a or b
    size = a[0].size
    out, carry, none = [], None, Bitmap.of(np.zeros(0, np.uint32), size)
    for k in range(max(len(a), len(b))):
        x, y = a[k] if k < len(a) else none, b[k] if k < len(b) else none
        half = x ^ y
        both = x & y
        if carry is None or not carry:
            out.append(half)
            carry = both
        else:
            out.append(half ^ carry)
            carry = both | (carry & half)
    if carry:
        out.append(carry)
    return out


def numbers(a: list[Bitmap], size: int) -> np.ndarray:
    """Decoded vector; beyond 62 slices as float64."""
    out = np.zeros(size, np.int64 if len(a) <= 62 else np.float64)
    for k, s in enumerate(a):
        out[s.ordinals()] += (1 << k) if len(a) <= 62 else float(1 << k)
    return out


def dump(parts: list[Bitmap]) -> bytes:
    out = [struct.pack("<I", len(parts))]
    for p in parts:
        data = p.array if p.array is not None else p.bits
        out += [struct.pack("<BII", p.array is not None, p.size, len(data)), data.tobytes()]
    return b"".join(out)


def load(data: memoryview, at: int) -> tuple[list[Bitmap], int]:
    (n,), at = struct.unpack_from("<I", data, at), at + 4
    parts = []
    for _ in range(n):
        sparse, size, length = struct.unpack_from("<BII", data, at)
        at += 9
        kind = np.uint32 if sparse else np.uint8
        values = np.frombuffer(data, kind, length, at)
        at += values.nbytes
        parts.append(Bitmap(size, array=values) if sparse else Bitmap(size, bits=values))
    return parts, at
