"""Hashes of words and word runs of many texts at once, in arrays."""

from __future__ import annotations

import numpy as np

# Multipliers of the mixing function.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD_STEP = np.uint64(0x9E3779B97F4A7C15)
BASE, BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * ODD_STEP)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n + n // 2), _powers(BASE_INVERSE, n + n // 2)
        return cls.up[:n], cls.down[:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the index of its text."""
    return placed_words(texts)[:2]


def placed_words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Hash and text of every word, its first byte and the byte after it within the text, and its number of digits.

    Words are runs without white space, lower-cased (A-Z). A word's hash is that
    of its UTF-8 bytes, so equal words have equal hashes anywhere.
    """
    data = "\n".join(texts).encode()
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 4
    space = SPACES[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    up, down = _Powers.of(len(raw))
    total = np.cumsum(LETTERS[low] * up, dtype=np.uint64)
    before = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))
    hashes = mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64) * ODD_STEP)
    size = [len(t) + 1 for t in texts] if data.isascii() else [len(t.encode()) + 1 for t in texts]
    ends = np.cumsum(size)
    text = np.searchsorted(ends, start, side="right")
    first = (ends - size)[text]
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57), dtype=np.int32)])
    return hashes, text, start - first, end - first, digits[end] - digits[start]


def runs(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``size`` words; a shorter text, but not an empty one, is one run."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    for k in range(size):
        m = max(n - k, 0)
        moved, inside = np.zeros(n, np.uint64), np.zeros(n, bool)
        moved[:m] = hashes[k:]
        inside[:m] = text[k:] == text[:m]
        out = mix(out + np.where(inside, moved, np.uint64(0)) + ODD_STEP)
        whole = inside
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    keep = whole | first
    return out[keep], text[keep]


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, with their counts: text, hash, count."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))
