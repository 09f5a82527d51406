"""Static binary fuse filters: a set of 64-bit keys in about 1.13 bytes a key, no false negatives, 1 in 256 false positives.

Each key owns one slot in each of three consecutive segments; the three slots' bytes together give the key's
fingerprint. Slots that only one key uses are peeled in rounds, and filled in the opposite order.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    high = (h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    low = [h & mask, (h >> np.uint64(11)) & mask, (h >> np.uint64(22)) & mask]
    return np.stack([((high + np.uint64(k)) * np.uint64(segment) + low[k]).astype(np.int64) for k in range(3)])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(56))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys; an empty set gives an empty filter."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = len(keys)
    if n == 0:
        return b""
    segment = min(1 << 11, 1 << max(2, int(np.log(n + 1) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment))
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = _slots(h, segment, segments)
        size = (segments + 2) * segment
        users, held = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for row in slots:
            np.add.at(users, row, 1)
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left, alone = [], n, np.flatnonzero(users == 1)
        while len(alone):
            peeled, first = np.unique(held[alone], return_index=True)
            rounds.append((peeled, alone[first]))
            left -= len(peeled)
            for row in slots:
                np.subtract.at(users, row[peeled], 1)
                np.bitwise_xor.at(held, row[peeled], peeled)
            touched = np.unique(slots[:, peeled])
            alone = touched[users[touched] == 1]
        if left == 0:
            table, prints = np.zeros(size, np.uint8), _fingerprint(h)
            for peeled, own in reversed(rounds):
                a, b, c = (table[row[peeled]] for row in slots)
                # The own slot is still zero, so it takes what the others lack.
                table[own] = prints[peeled] ^ a ^ b ^ c
            return _HEAD.pack(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, segments, n) + table.tobytes()
        segments += 1 + segments // 50
    raise RuntimeError("no seed peels the keys")


def may_contain(data: bytes, keys: np.ndarray) -> np.ndarray:
    if not data:
        return np.zeros(len(keys), bool)
    seed, segment, segments, _ = _HEAD.unpack_from(data)
    table = np.frombuffer(data, np.uint8, offset=_HEAD.size)
    h = _mix(np.asarray(keys).astype(np.uint64), seed)
    a, b, c = (table[row] for row in _slots(h, segment, segments))
    return (a ^ b ^ c) == _fingerprint(h)
