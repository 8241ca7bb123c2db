"""Golomb-Rice coding of sorted distinct fingerprints, as numpy bit arrays.

A block codes n sorted numbers below 2**bits by their gaps: the quotient by 2**k in unary,
the remainder in k bits. With k near the log of the mean gap a fingerprint costs about
log2(2**bits / n) + 1.5 bits.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<IBxxx"
HEAD_SIZE = struct.calcsize(HEAD)


def rice_parameter(count: int, bits: int) -> int:
    """Bits of the remainder: floor(log2(mean gap)), at least 0."""
    return max(0, bits - max(1, count).bit_length())


def encode(values: np.ndarray, bits: int) -> bytes:
    """Code sorted distinct uint64 values below 2**bits."""
    count = len(values)
    if not count:
        return struct.pack(HEAD, 0, 0)
    k = rice_parameter(count, bits)
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    parts = [struct.pack(HEAD, count, k), struct.pack("<Q", len(unary)), np.packbits(unary).tobytes()]
    if k:
        rest = (gaps & np.uint64((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(count, 8)
        parts.append(np.packbits(np.unpackbits(rest, axis=1)[:, 64 - k :].ravel()).tobytes())
    return b"".join(parts)


def decode(blob: bytes) -> np.ndarray:
    """The values of encode(), in order."""
    count, k = struct.unpack_from(HEAD, blob)
    if not count:
        return np.zeros(0, dtype=np.uint64)
    (width,) = struct.unpack_from("<Q", blob, HEAD_SIZE)
    start = HEAD_SIZE + 8
    stop = start + (width + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, stop - start, start), count=width)
    ends = np.flatnonzero(unary)
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        packed = np.frombuffer(blob, np.uint8, (count * k + 7) // 8, stop)
        rest = np.zeros((count, 64), dtype=np.uint8)
        rest[:, 64 - k :] = np.unpackbits(packed, count=count * k).reshape(count, k)
        gaps |= np.packbits(rest, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
