"""Counting quotient filters of packed n-grams, as arrays in memory and as compact bytes between tasks.

A key is up to three word ids of ``bits`` bits each (0: no word). It is permuted by a Feistel network on its two
halves, which can be undone, so a filter loses nothing: the leading bits of the permuted key are its quotient, all
other bits are kept as its remainder. The permutation spreads keys evenly, whatever the words, so a range of quotients
(a *part*) holds about its share of all keys.

In memory a filter is sorted by the permuted key: halves ``x`` and ``y`` and the counts. As bytes it holds, for one
part, which quotients occur (one bit for each), which entry ends the run of its quotient (one bit for each), the
remainders in whole bytes, and a counter of one byte; a count of 255 or more has its eight bytes apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = np.dtype("<i8")


def _scramble(v: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (v + np.uint64(1)) * np.uint64(key)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        return v ^ (v >> np.uint64(32))


@dataclass(frozen=True)
class Layout:
    """How keys of three ids of ``bits`` bits are packed and permuted, and how many leading bits name the part."""

    bits: int
    part_bits: int

    def __post_init__(self):
        if not (1 <= self.bits <= 40 and 0 <= self.part_bits <= min(self.left, 31)):
            raise ValueError(self)

    @property
    def left(self) -> int:
        return (3 * self.bits + 1) // 2

    @property
    def right(self) -> int:
        return 3 * self.bits // 2

    def permute(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x, y) of the keys (a, b, c): the halves of the packed key after the rounds."""
        a, b, c = (v.astype(np.uint64) for v in (a, b, c))
        low = self.right - self.bits  # bits of b that go to the right half
        x = a << np.uint64(self.bits - low) | b >> np.uint64(low)
        y = (b & np.uint64((1 << low) - 1)) << np.uint64(self.bits) | c
        mx, my = np.uint64((1 << self.left) - 1), np.uint64((1 << self.right) - 1)
        for i, k in enumerate(_ROUNDS):
            if i % 2:
                y = y ^ _scramble(x, k) & my
            else:
                x = x ^ _scramble(y, k) & mx
        return x, y

    def restore(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of (x, y)."""
        mx, my = np.uint64((1 << self.left) - 1), np.uint64((1 << self.right) - 1)
        for i, k in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                y = y ^ _scramble(x, k) & my
            else:
                x = x ^ _scramble(y, k) & mx
        low = self.right - self.bits
        one = np.uint64((1 << self.bits) - 1)
        b = (x & np.uint64((1 << (self.bits - low)) - 1)) << np.uint64(low) | y >> np.uint64(self.bits)
        return tuple(v.astype(np.int64) for v in (x >> np.uint64(self.bits - low), b, y & one))

    def part(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(self.left - self.part_bits)).astype(np.int64)


@dataclass
class Filter:
    """Keys in the order of (x, y), each once, and their counts."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def slice(self, a: int, b: int) -> Filter:
        return Filter(self.x[a:b], self.y[a:b], self.n[a:b])


def merged(layout: Layout, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Filter:
    """A filter of keys in any order, repeats added up; without ``n`` each counts once."""
    if 3 * layout.bits <= 64:  # both halves in one number
        key = x << np.uint64(layout.right) | y
        if n is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, total = key[new], len(key)
        x, y = key >> np.uint64(layout.right), key & np.uint64((1 << layout.right) - 1)
    else:
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], None if n is None else n[order]
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, np.int64)
        total = len(x)
        x, y = x[new], y[new]
    if n is None:
        return Filter(x, y, np.diff(np.append(new, total)))
    return Filter(x, y, np.add.reduceat(n, new) if len(new) else n)


def merge(layout: Layout, filters: list[Filter]) -> Filter:
    return merged(layout, *(np.concatenate([getattr(f, v) for f in filters]) for v in ("x", "y", "n")))


def _planes(v: np.ndarray, width: int) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack(layout: Layout, f: Filter) -> bytes:
    """The entries of one part as bytes. The number of quotient bits follows the number of entries."""
    n = len(f)
    rest = layout.left - layout.part_bits
    q = min(rest, max(0, n.bit_length() - 1))
    keep = rest - q  # bits of x below the quotient
    quotient = ((f.x >> np.uint64(keep)) & np.uint64((1 << q) - 1)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    wx, wy = -(-keep // 8), -(-layout.right // 8)
    large = f.n >= 255
    return b"".join([np.array([n, q], _HEAD).tobytes(), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                     _planes(f.x & np.uint64((1 << keep) - 1), wx), _planes(f.y, wy),
                     np.where(large, 255, f.n).astype(np.uint8).tobytes(), f.n[large].astype(_HEAD).tobytes()])


def unpack(layout: Layout, part: int, raw: bytes) -> Filter:
    n, q = map(int, np.frombuffer(raw, _HEAD, 2))
    rest = layout.left - layout.part_bits
    keep = rest - q
    wx, wy = -(-keep // 8), -(-layout.right // 8)
    at = 16

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return raw[at - size:at]

    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(take(-(-(1 << q) // 8)), np.uint8), count=1 << q))
    ends = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n)
    x = _unplanes(take(wx * n), n, wx)
    y = _unplanes(take(wy * n), n, wy)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, _HEAD, offset=at)
    run = np.cumsum(ends) - ends  # which of the occupied quotients an entry has
    x |= occupied[run].astype(np.uint64) << np.uint64(keep) if n else x
    return Filter(x | np.uint64(part) << np.uint64(rest), y, counts)
