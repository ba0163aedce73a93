"""Golomb-Rice codes of sorted integers, in numpy.

Gaps between sorted values follow a geometric law when the values are hashes, for
which these codes are near the shortest. Quotients (unary) and remainders (fixed
width) lie in two streams, so both directions work on whole arrays.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBI")
_BLOCK = 1 << 16


def encode(values: np.ndarray, base: int = 0) -> bytes:
    """Code of strictly rising ``uint64`` values, each at least ``base``."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values, prepend=np.uint64(base))
    mean = max(1, int(gaps.mean() * 0.69))
    k = mean.bit_length() - 1
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    quotients = np.packbits(unary).tobytes()
    shifts = np.arange(k, dtype=np.uint64)
    rest = []
    for at in range(0, n, _BLOCK) if k else ():
        bits = (gaps[at : at + _BLOCK, None] >> shifts) & np.uint64(1)
        rest.append(np.packbits(bits.astype(np.uint8).ravel()).tobytes())
    return _HEAD.pack(n, k, len(quotients)) + quotients + b"".join(rest)


def decode(code: bytes, base: int = 0) -> np.ndarray:
    n, k, size = _HEAD.unpack_from(code)
    if not n:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(code, np.uint8, offset=_HEAD.size)
    ends = np.flatnonzero(np.unpackbits(raw[:size]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    weights = np.uint64(1) << np.arange(k, dtype=np.uint64)
    rest = raw[size:]
    for at in range(0, n, _BLOCK) if k else ():
        m = min(_BLOCK, n - at)
        lo = at * k // 8  # a block of 2^16 values fills whole bytes
        bits = np.unpackbits(rest[lo : lo + (m * k + 7) // 8], count=m * k).reshape(m, k)
        gaps[at : at + m] |= bits.astype(np.uint64) @ weights
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)
