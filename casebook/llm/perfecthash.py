"""Minimal perfect hashing of 64-bit keys by levels of bit arrays, with stored fingerprints.

On each level the keys still left hash to a bit array; a key alone on its bit stays there, the
others go on to the next level. A key's slot is the rank of its bit among all set bits, so n keys
fill the slots 0 to n - 1. A fingerprint of 32 bits in the slot tells keys that were never stored.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
WORD = np.uint64(64)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Keys scattered over 64 bits, otherwise for each seed."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """``sizes`` bits a level, ``bits`` all levels one after the other, ``ranks`` set bits before each word."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.uint64), bits.astype(np.uint64)
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.ranks = np.concatenate(([0], np.cumsum(counts)))[:-1] if len(counts) else counts
        self.n = int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct signed or unsigned 64-bit integers, any number."""
        left, sizes, words, level = np.ascontiguousarray(keys), [], [], 0
        while len(left):
            size = max(64, int(np.ceil(len(left) * GAMMA / 64)) * 64)
            at = mixed(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            word = np.packbits(alone, bitorder="little").view(np.uint64)
            sizes.append(size)
            words.append(word)
            left = left[~alone[at.astype(np.int64)]]
            level += 1
        return cls(np.array(sizes, np.uint64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit. A key never stored may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = base + (mixed(keys[todo], level) % size).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + int(size)
        return out


class KeyIndex:
    """Key to a row of integers: perfect hash, fingerprint a slot, values a slot."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, values: np.ndarray):
        self.hashing, self.prints, self.values = hashing, prints, values

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> KeyIndex:
        hashing = PerfectHash.build(keys)
        slots = hashing.slots(keys)
        prints, rows = np.zeros(len(keys), np.uint32), np.zeros(values.shape, np.int64)
        prints[slots], rows[slots] = fingerprints(keys), values
        return cls(hashing, prints, rows)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values); a foreign key passes the fingerprint once in 2^32."""
        slots = self.hashing.slots(keys)
        found = slots >= 0
        found[found] = self.prints[slots[found]] == fingerprints(keys[found])
        return found, self.values[np.where(found, slots, 0)] if len(self.values) else np.zeros((len(keys), self.values.shape[1]), np.int64)

    def dump(self) -> bytes:
        """Little-endian: three 64-bit counts (levels, keys, columns), then sizes, bits, fingerprints and values."""
        head = np.array([len(self.hashing.sizes), len(self.prints), self.values.shape[1]], "<u8")
        parts = (head, self.hashing.sizes.astype("<u8"), self.hashing.bits.astype("<u8"), self.prints.astype("<u4"), self.values.astype("<i8"))
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def load(cls, data: bytes) -> KeyIndex:
        levels, n, columns = (int(x) for x in np.frombuffer(data, "<u8", 3))
        sizes = np.frombuffer(data, "<u8", levels, 24)
        at = 24 + 8 * levels
        words = int(sizes.sum()) // 64
        bits = np.frombuffer(data, "<u8", words, at)
        prints = np.frombuffer(data, "<u4", n, at + 8 * words)
        values = np.frombuffer(data, "<i8", n * columns, at + 8 * words + 4 * n).reshape(n, columns)
        return cls(PerfectHash(sizes, bits), prints, values)
