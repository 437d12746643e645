"""Binary fuse filters (Graf and Lemire, 2022) over 64-bit keys, built with NumPy.

A key has one place in each of three neighbouring segments; the three 16-bit cells there
give, by exclusive or, the key's fingerprint. A key that was put in is always found;
another one is found with probability 2**-16.
"""

from __future__ import annotations

import math

import numpy as np

_TRIES = 100


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments that a first place falls into."""
    if n < 2:
        return 4, 1
    length = min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
    capacity = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))) + 32
    return length, max(1, math.ceil(capacity / length) - 2)


def _places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    first = ((h >> np.uint64(32)) * np.uint64(length * segments)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


def _peeled(places: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell that the key alone uses), or None if some keys are left over."""
    n = len(places)
    uses = np.bincount(places.ravel(), minlength=cells)
    # the exclusive or of the keys at a cell: where one is left, this is its number
    owner = np.zeros(cells, np.int64)
    np.bitwise_xor.at(owner, places.ravel(), np.repeat(np.arange(n), 3))
    rounds, done = [], 0
    free = np.flatnonzero(uses == 1)
    while len(free):
        keys, at = np.unique(owner[free], return_index=True)
        rounds.append((keys, free[at]))
        done += len(keys)
        touched = places[keys].ravel()
        np.subtract.at(uses, touched, 1)
        np.bitwise_xor.at(owner, touched, np.repeat(keys, 3))
        touched = np.unique(touched)
        free = touched[uses[touched] == 1]
    return rounds if done == n else None


def build(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, segments and cells of the filter for these keys."""
    keys = np.unique(np.asarray(keys, np.int64)).view(np.uint64)
    length, segments = _shape(len(keys))
    cells = (segments + 2) * length
    for seed in range(1, _TRIES):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        places = _places(h, length, segments)
        rounds = _peeled(places, cells)
        if rounds is not None:
            table = np.zeros(cells, np.uint16)
            marks = _fingerprints(h)
            for members, own in reversed(rounds):
                at = places[members]
                # the own cell is still zero
                table[own] = marks[members] ^ table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]
            return seed, length, segments, table
    raise RuntimeError("no seed gives a filter")


def contains(keys: np.ndarray, seed: int, length: int, segments: int, table: np.ndarray) -> np.ndarray:
    h = _mixed(np.asarray(keys, np.int64).view(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    at = _places(h, length, segments)
    return (table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]) == _fingerprints(h)
