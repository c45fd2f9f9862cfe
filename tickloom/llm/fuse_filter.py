"""Binary fuse filters over 64-bit keys: static sets with no false negatives, 9 bits a key, 1 in 256 false positives.

A key sits in three cells of neighbouring segments; the xor of the cells is the key's fingerprint.
Building peels keys that own a cell alone, round by round, and fills the cells in reverse order.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
HEADER = 4  # seed, segment length, segments, array length


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Murmur's 64-bit finaliser over key + seed."""
    h = keys + _U(seed)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _cells(h: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    span, mask = _U(segments * length), _U(length - 1)
    first = ((h >> _U(32)) * span) >> _U(32)
    second = (first + _U(length)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * length)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of these keys (any 64-bit integers, repeats allowed)."""
    keys = np.unique(np.asarray(keys).astype(np.int64).view(_U))
    n = len(keys)
    length = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / length) - 2)
    for attempt in range(100):
        seed = (attempt + 1) * 0x9E3779B97F4A7C15 & (2**63 - 1)
        if attempt % 10 == 9:
            segments += 1 + segments // 8
        size = (segments + 2) * length
        h = _mixed(keys, seed)
        cells = np.stack(_cells(h, length, segments))
        count = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # the sum of the keys' numbers in a cell; of a lone key, its number
        for row in cells:
            np.add.at(owner, row, np.arange(n))
        rounds, left = [], n
        lone = np.flatnonzero(count == 1)
        while len(lone):
            mine, at = np.unique(owner[lone], return_index=True)
            rounds.append((mine, lone[at]))
            left -= len(mine)
            touched = cells[:, mine]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.subtract.at(owner, row, mine)
            near = np.unique(touched)
            lone = near[count[near] == 1]
        if left == 0:
            break
    else:
        raise RuntimeError("the filter could not be built")
    table, prints = np.zeros(size, np.uint8), _prints(h)
    for mine, own in reversed(rounds):
        a, b, c = table[cells[0, mine]], table[cells[1, mine]], table[cells[2, mine]]
        table[own] = prints[mine] ^ a ^ b ^ c ^ table[own]  # its own cell cancels out
    return np.array([seed, length, segments, size], np.int64).tobytes() + table.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the set, and for about 1 in 256 others."""
    seed, length, segments, size = (int(x) for x in np.frombuffer(blob, np.int64, HEADER))
    table = np.frombuffer(blob, np.uint8, size, HEADER * 8)
    h = _mixed(np.asarray(keys).astype(np.int64).view(_U), seed)
    a, b, c = _cells(h, length, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
