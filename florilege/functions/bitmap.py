"""Compressed bitmaps over one range of 65,536 integers: a sorted array of uint16 while sparse, a bitset when dense."""

from __future__ import annotations

import numpy as np

RANGE_BITS = 16
RANGE = 1 << RANGE_BITS
#: Above this many members the bitset (8 KB) is smaller than the array.
SPARSE = 4096


def encode(members: np.ndarray) -> bytes:
    members = np.unique(np.asarray(members, dtype=np.uint16))
    if len(members) <= SPARSE:
        return b"A" + members.tobytes()
    bits = np.zeros(RANGE, bool)
    bits[members] = True
    return b"B" + np.packbits(bits).tobytes()


def flags(container: bytes | None) -> np.ndarray:
    """The range as 65,536 booleans; None is the empty bitmap."""
    if container is None:
        return np.zeros(RANGE, bool)
    if container[:1] == b"B":
        return np.unpackbits(np.frombuffer(container, np.uint8, offset=1)).astype(bool)
    bits = np.zeros(RANGE, bool)
    bits[np.frombuffer(container, np.uint16, offset=1)] = True
    return bits


def decode(container: bytes | None) -> np.ndarray:
    """The members in ascending order, as int64."""
    if container is not None and container[:1] == b"A":
        return np.frombuffer(container, np.uint16, offset=1).astype(np.int64)
    return np.flatnonzero(flags(container))


def _keep(a: bytes, b: bytes | None, inside: bool) -> bytes:
    if a[:1] == b"A":
        members = np.frombuffer(a, np.uint16, offset=1)
        return encode(members[flags(b)[members] == inside])
    return encode(np.flatnonzero(flags(a) & (flags(b) == inside)))


def and_not(a: bytes, b: bytes | None) -> bytes:
    return _keep(a, b, False)


def intersect(a: bytes, b: bytes | None) -> bytes:
    return _keep(a, b, True)


def union(a: bytes | None, b: bytes | None) -> bytes:
    return encode(np.concatenate([decode(a), decode(b)]))
