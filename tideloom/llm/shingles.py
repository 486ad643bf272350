"""Word shingles of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

# Words are runs of digits, ASCII letters (lower-cased) and bytes from 0x80.
_MAPPED = np.zeros(256, np.uint64)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _MAPPED[_b] = _b
for _b in range(0x41, 0x5B):
    _MAPPED[_b] = _b + 32

#: Bytes that are hashed at a time: sixty bytes of memory for each.
BLOCK = 256 << 10

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Hashes of runs of ``width`` words; a text with fewer words, but not none, has one shingle of all its words."""

    def __init__(self, width: int = 5):
        self.width = width
        self.factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, _P, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = _P_INVERSE
            self.inverses = np.multiply.accumulate(steps)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every word, in order. Works in blocks, however long a text is."""
        data = b" ".join(texts) + b" "
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        found, start = [], 0
        while start < len(data):
            stop = min(start + BLOCK, len(data))
            while _MAPPED[data[stop - 1]]:
                stop += 1
            at, hashes = self._block(np.frombuffer(data, np.uint8, stop - start, start))
            found.append((np.searchsorted(ends, at + start, side="right"), hashes))
            start = stop
        number, hashes = zip(*found) if found else ([np.zeros(0, np.int64)], [np.zeros(0, np.uint64)])
        return np.concatenate(number), np.concatenate(hashes)

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of every word."""
        mapped = _MAPPED[data]
        inside = mapped > 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._tables(len(data) + 1)
        mapped *= self.powers[: len(data)]
        total = np.cumsum(mapped)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        return starts, mix((total[ends - 1] - before) * self.inverses[starts])

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every shingle, sorted by text number."""
        number, words = self.words(texts)
        width, n = self.width, len(words)
        counts = np.bincount(number, minlength=len(texts))
        first = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= width:
            whole = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                whole += words[j : n - width + 1 + j] * self.factors[j]
            valid = number[: n - width + 1] == number[width - 1 :]
            whole, owner = whole[valid], number[: n - width + 1][valid]
        few = np.zeros(len(short), np.uint64)
        for j in range(width):
            has = counts[short] > j
            few[has] += words[first[short[has]] + j] * self.factors[j]
        owner = np.concatenate([owner, short])
        hashes = mix(np.concatenate([whole, few]))
        order = np.argsort(owner, kind="stable")
        return owner[order], hashes[order]

    def multisets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, shingle, how often), sorted by text number and shingle."""
        owner, hashes = self.shingles(texts)
        if not len(owner):
            return owner, hashes, np.zeros(0, np.int64)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        return owner[at], hashes[at], np.diff(at, append=len(owner))
