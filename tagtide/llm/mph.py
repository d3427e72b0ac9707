"""Minimal perfect hash in numpy: levels of bit arrays (Limasset et al., 2017).

A key takes the first level where no other key shares its position; its rank
among the set bits is its slot, so n keys fill the slots 0..n-1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_GAMMA = 2.0
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 + h2 * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # positions per level
    bits: np.ndarray   # packed bits of all levels, each level byte-aligned

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        """Over distinct 128-bit keys given as two uint64 arrays."""
        sizes, packed = [], []
        while len(h1):
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, int(_GAMMA * len(h1)))
            pos = _position(h1, h2, len(sizes), size).astype(np.int64)
            alone = np.bincount(pos, minlength=size) == 1
            packed.append(np.packbits(alone))
            sizes.append(size)
            left = ~alone[pos]
            h1, h2 = h1[left], h2[left]
        return cls(np.array(sizes, np.int64), np.concatenate(packed) if packed else np.zeros(0, np.uint8))

    def to_bytes(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + self.sizes.tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return cls(np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint8, offset=8 + 8 * n))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level holds it (not a member).
        Other strangers get some slot: compare its fingerprint."""
        out = np.full(len(h1), -1, np.int64)
        todo, base, at = np.arange(len(h1)), 0, 0
        for level, size in enumerate(self.sizes):
            here = np.unpackbits(self.bits[at:at + (size + 7) // 8], count=int(size))
            rank = np.cumsum(here, dtype=np.int64) - 1 + base
            pos = _position(h1[todo], h2[todo], level, int(size)).astype(np.int64)
            hit = here[pos] == 1
            out[todo[hit]] = rank[pos[hit]]
            todo = todo[~hit]
            base, at = base + int(here.sum()), at + (int(size) + 7) // 8
        return out
