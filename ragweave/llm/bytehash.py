"""Vectorised hashes of words and windows over the UTF-8 bytes of many texts at once.

A window's hash is the difference of two prefix sums of ``byte * BASE**position``, brought to a
common power and mixed; all arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C1B)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_table: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, from one table that grows by doubling."""
    if not _table or len(_table[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _table[:] = [np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)]
    return _table[0][:n], _table[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit mixing hash (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefix:
    """Prefix sums of one block of bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed hashes of the byte ranges [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def every(self, k: int) -> np.ndarray:
        """Mixed hashes of all windows of ``k`` bytes."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


#: Upper-case A-Z to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space; ``cuts`` (row offsets) end a run too."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] |= word[inner]
    last[inner - 1] |= word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_end(data: np.ndarray, at: int, stop: int, step: int = 1 << 16) -> int:
    """The first place from ``at`` on that is white space, ``stop`` at the latest."""
    for a in range(at, stop, step):
        space = SPACE[data[a : min(stop, a + step)]]
        if space.any():
            return a + int(np.argmax(space))
    return stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the rows, and the number of words of each row.

    Bytes are taken in pieces of about ``most`` bytes that end at white space, so that memory follows
    the number of words and not sixty times the bytes of a very long text.
    """
    hashes, starts, at, n = [], [], 0, len(data)
    while at < n:
        end = min(n, at + most)
        end = word_end(data, end, int(offsets[np.searchsorted(offsets, end)]))
        piece = LOWER[data[at:end]]
        a, b = word_spans(piece, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at)
        hashes.append(Prefix(piece).windows(a, b))
        starts.append(a + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    at = np.searchsorted(np.concatenate(starts), offsets)
    return np.concatenate(hashes), np.diff(at)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row (a shorter row is one run), and their counts."""
    n = len(words)
    out_counts = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), out_counts
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the row's end
    total = np.zeros(n, np.uint64)
    for j in range(k):
        term = np.zeros(n, np.uint64)
        term[: n - j] = words[j:]
        total = total * np.uint64(0x9FB21C651E98DF25) + np.where(left > j, mix(term + np.uint64(j + 1)), np.uint64(j + 1))
    first = np.arange(n) == np.repeat(ends - counts, counts)
    keep = (left >= k) | (first & (counts[row] < k))
    return mix(total[keep] + np.minimum(counts[row], k)[keep].astype(np.uint64)), out_counts
