"""Distinct n-grams of a batch in an open-addressed table of numpy arrays.

The words of a batch lie in one buffer, joined by single spaces, so an n-gram is a start and a
length there. Its key is the XXH64 of its bytes. The table has a power of two of slots, at least
twice the occurrences; all occurrences probe at once: those at an empty slot claim it, those at a
slot of the same key compare bytes with the n-gram that owns it, and whoever finds another moves on
to the next slot. Two n-grams with one key thus stay two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import xxhash

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: n-grams from this many bytes on are hashed by the library, one by one.
LONG = 32


@cache
def crc_tables() -> np.ndarray:
    """CRC-32 of a byte followed by 0 to 7 zero bytes, as a register without start and end values."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    tables = [out]
    for _ in range(7):
        tables.append((tables[-1] >> np.uint32(8)) ^ out[tables[-1] & np.uint32(255)])
    return np.stack(tables)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Text:
    """A buffer of bytes of which eight can be read at any place."""

    def __init__(self, data: bytes):
        self.data = data + bytes(8)
        self.eights = np.ndarray((len(data) + 1,), "<u8", self.data, strides=(1,))

    def lane(self, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of n-grams longer than 8 * k bytes, zeros past the end."""
        left = np.minimum(length - 8 * k, 8).astype(np.uint64)
        return self.eights[start + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XXH64 of each n-gram, seed 0."""
        h = P5 + length.astype(np.uint64)
        short = length < LONG
        for k in range(LONG // 8):
            at = np.flatnonzero(short & (length >= 8 * (k + 1)))
            part = self.eights[start[at] + 8 * k]
            h[at] = _turned(h[at] ^ (_turned(part * P2, 31) * P1), 27) * P1 + P4
        done = length & ~7
        at = np.flatnonzero(short & (length & 4 > 0))
        part = self.eights[start[at] + done[at]] & np.uint64(0xFFFFFFFF)
        h[at] = _turned(h[at] ^ (part * P1), 23) * P2 + P3
        done = length & ~3
        for k in range(3):
            at = np.flatnonzero(short & (length & 3 > k))
            part = self.eights[start[at] + done[at] + k] & np.uint64(0xFF)
            h[at] = _turned(h[at] ^ (part * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(~short).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[start[i] : start[i] + length[i]])
        return h

    def crcs(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of each n-gram."""
        tables, short = crc_tables(), length < LONG
        out = np.full(len(start), 0xFFFFFFFF, np.uint32)
        for k in range(LONG // 8):
            at = np.flatnonzero(short & (length >= 8 * (k + 1)))
            eight = (self.eights[start[at] + 8 * k] ^ out[at]).view(np.uint8).reshape(-1, 8)
            crc = tables[7][eight[:, 0]]
            for i in range(1, 8):
                crc ^= tables[7 - i][eight[:, i]]
            out[at] = crc
        done = length & ~7
        for k in range(7):
            at = np.flatnonzero(short & (length & 7 > k))
            byte = self.eights[start[at] + done[at] + k].astype(np.uint32)
            out[at] = (out[at] >> np.uint32(8)) ^ tables[0][(out[at] ^ byte) & np.uint32(255)]
        out = ~out
        for i in np.flatnonzero(~short).tolist():
            out[i] = crc32(self.data[start[i] : start[i] + length[i]])
        return out

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the n-grams at ``a`` and at ``b``, of one length each, hold the same bytes."""
        equal, at, k = np.ones(len(a), bool), np.arange(len(a)), 0
        while len(at):
            same = self.lane(a[at], length[at], k) == self.lane(b[at], length[at], k)
            equal[at[~same]] = False
            k += 1
            at = at[same & (length[at] > 8 * k)]
        return equal


class Table:
    """The distinct n-grams of some occurrences: one row per slot in use, and for each occurrence the row it owns or shares."""

    def __init__(self, text: Text, start: np.ndarray, length: np.ndarray, keys: np.ndarray | None = None):
        keys = text.hashes(start, length) if keys is None else keys
        size = 1 << max(4, int(2 * len(start) - 1).bit_length())
        owner = np.full(size, -1, np.int64)
        slot = (keys & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(start))
        while len(waiting):
            free = waiting[owner[slot[waiting]] < 0]
            owner[slot[free]] = free  # of several claims one is left
            other = owner[slot[waiting]]
            met = (keys[other] == keys[waiting]) & (length[other] == length[waiting])
            check = np.flatnonzero(met & (other != waiting))
            met[check] = text.same(start[other[check]], start[waiting[check]], length[waiting[check]])
            waiting = waiting[~met]
            slot[waiting] = (slot[waiting] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        row = np.empty(size, np.int64)
        row[used] = np.arange(len(used))
        self.rows = row[slot]
        self.start, self.length = start[owner[used]], length[owner[used]]
        self.counts = np.bincount(self.rows, minlength=len(used))
        self.text = text

    def buckets(self, n: int) -> np.ndarray:
        """CRC-32 of each distinct n-gram, modulo ``n``."""
        return self.text.crcs(self.start, self.length).astype(np.int64) % n


def interned(texts: list[list[bytes]], order: int, most: int = 1 << 15) -> Iterator[tuple[Table, np.ndarray]]:
    """Tables over all runs of 1 to ``order`` words, and for each occurrence the number of its text.

    A table takes about ``most`` words. A longer text is dealt over several: each part brings the
    words that its last runs reach into, and owns the runs that begin in it.
    """
    parts: list[tuple[int, list[bytes], int]] = []
    size = 0
    for number, words in enumerate(texts):
        for lo in range(0, len(words), most):
            own = min(most, len(words) - lo)
            if size + own > most and parts:
                yield _table(parts, order)
                parts, size = [], 0
            parts.append((number, words[lo : lo + own + order - 1], own))
            size += own
    if parts:
        yield _table(parts, order)


def _table(parts: list[tuple[int, list[bytes], int]], order: int) -> tuple[Table, np.ndarray]:
    data = b" ".join(b" ".join(words) for _, words, _ in parts)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = np.array([len(words) for _, words, _ in parts])
    part = np.repeat(np.arange(len(parts)), sizes)
    first = np.cumsum(sizes) - sizes
    owned = np.arange(len(part)) - first[part] < np.array([own for *_, own in parts])[part]
    begin, length, of = [], [], []
    for n in range(order):
        at = np.flatnonzero(owned[: len(part) - n] & (part[: len(part) - n] == part[n:])) if n < len(part) else np.zeros(0, int)
        begin.append(starts[at])
        length.append(ends[at + n] - starts[at])
        of.append(part[at])
    numbers = np.array([number for number, *_ in parts])
    return Table(Text(data), np.concatenate(begin), np.concatenate(length)), numbers[np.concatenate(of)]
