"""A cuckoo filter over 128-bit keys: insert, delete, vectorised look-up, bytes in and out.

Buckets have four slots of 16-bit fingerprints. A key's second bucket follows from its first and
its fingerprint, so entries can move without their key. A filter that can take no more gets a
further layer of twice the size; nothing is ever refused. Look-ups have no false negatives for
keys that are in; a delete must be of a key that is in, which the exact tables beside it ensure.
"""

from __future__ import annotations

import struct

import numpy as np

SLOTS, KICKS = 4, 200
MIX = 0x5BD1E995  # any odd constant that spreads fingerprints over the buckets


class CuckooFilter:
    def __init__(self, buckets: int = 64):
        self.layers = [np.zeros((_power_of_two(buckets), SLOTS), np.uint16)]

    @staticmethod
    def _print_of(k2: int) -> int:
        return (k2 & 0xFFFF) or 1

    def _places(self, table: np.ndarray, k1: int, f: int) -> tuple[int, int]:
        mask = len(table) - 1
        a = k1 & mask
        return a, a ^ ((f * MIX) & mask)

    def insert(self, k1: int, k2: int) -> None:
        f = self._print_of(k2)
        table = self.layers[-1]
        for at in self._places(table, k1, f):
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = f
                return
        moved = []
        mask = len(table) - 1
        at = k1 & mask
        for step in range(KICKS):
            slot = (f + step) % SLOTS
            moved.append((at, slot, int(table[at, slot])))
            f, table[at, slot] = moved[-1][2], f
            at ^= (f * MIX) & mask
            free = np.flatnonzero(table[at] == 0)
            if len(free):
                table[at, free[0]] = f
                return
        for at, slot, old in reversed(moved):
            table[at, slot] = old
        self.layers.append(np.zeros((2 * len(table), SLOTS), np.uint16))
        self.insert(k1, k2)

    def delete(self, k1: int, k2: int) -> bool:
        f = self._print_of(k2)
        for table in reversed(self.layers):
            for at in self._places(table, k1, f):
                held = np.flatnonzero(table[at] == f)
                if len(held):
                    table[at, held[0]] = 0
                    return True
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """For arrays of int64 halves of keys: whether each may be in."""
        k1, f = k1.astype(np.uint64), (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        f[f == 0] = 1
        found = np.zeros(len(k1), bool)
        for table in self.layers:
            mask = np.uint64(len(table) - 1)
            a = k1 & mask
            b = a ^ ((f.astype(np.uint64) * np.uint64(MIX)) & mask)
            found |= (table[a] == f[:, None]).any(axis=1) | (table[b] == f[:, None]).any(axis=1)
        return found

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{1 + len(self.layers)}I", len(self.layers), *map(len, self.layers))
        return head + b"".join(t.tobytes() for t in self.layers)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        (n,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{n}I", data, 4)
        out, at = cls(1), 4 + 4 * n
        out.layers = []
        for size in sizes:
            out.layers.append(np.frombuffer(data, np.uint16, size * SLOTS, at).reshape(size, SLOTS).copy())
            at += size * SLOTS * 2
        return out


def _power_of_two(n: int) -> int:
    return 1 << max(0, (max(1, n) - 1).bit_length())
