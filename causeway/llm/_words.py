"""Words of many texts at once: numpy finds them in the UTF-8 bytes and hashes them by prefix sums."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: An odd multiplier, its inverse modulo 2 ** 64, and a table that spreads byte values over 64 bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call."""
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, _U)
        p[0] = 1
        have = _POWERS[base, 0] = np.cumprod(p)
    return have[:n]


def forget() -> None:
    """Drop the kept powers, which are as many as the longest texts had bytes."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (in place where it can)."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def sums(value: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any range of symbols (64 bits each) is had from its two ends."""
    out = np.zeros(len(value) + 1, _U)
    np.cumsum(value * powers(BASE, len(value)), out=out[1:])
    return out


def prefix(raw: np.ndarray) -> np.ndarray:
    """The same for bytes."""
    return sums(SPREAD[raw])


def ranges(summed: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((summed[end] - summed[start]) * powers(INVERSE, len(summed))[start])


def find(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the text that it is in."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


#: The kind of a byte in a word's shape: upper, lower (or not ASCII), digit; any other stands for itself.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48


def shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: its kinds of bytes, runs of one kind taken as one."""
    kind = KIND[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return ranges(prefix(kind[keep]), place[start], place[end])
