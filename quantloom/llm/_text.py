"""Words, word hashes and n-gram hashes of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_B = U(0x9E3779B97F4A7C15)
_C = U(0xD6E8FEB86659FD93)


def _inverse(x: int) -> int:
    """Of an odd x modulo 2**64."""
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % 2**64
    return y


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=U) * _B) | U(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        steps = np.full(size, base, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


#: Bytes that end a word: [\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside the words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are lower case.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of each word, and for each row the number of words before it (one more entry than rows). No word crosses a row."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    inside = ~gaps[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_VALUES[raw] * _power_table(int(_B), len(raw)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power_table(_inverse(int(_B)), len(raw) + 1)[starts]
        return mix(h ^ ((ends - starts).astype(U) * _C))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i+k] for each i that has so many; rows are not looked at."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= _C
            out += h[j : j + n]
    return mix(out ^ U(k))


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from words()[2]."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that stay within their row, in order."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    row = row_of(first)
    return np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
