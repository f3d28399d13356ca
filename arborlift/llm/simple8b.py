"""Simple-8b word-aligned integer coding, vectorised over blocks.

A 64-bit word holds a selector in its top 4 bits and up to 60 values of equal
width below. Values are coded in blocks of ``BLOCK``; a block starts on a word of
its own, so blocks are decoded side by side from their offsets. Selector 0 is the
escape: the next word is one raw value of more than 60 bits. Unused places of a
block's last word are zero.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
# How many values a word holds by selector; selector 0 is the escape.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BITS = np.concatenate([[64], 60 // COUNTS[1:]])
LAST = len(COUNTS) - 1


SHORT_WIDTHS = np.ceil(np.log2(np.maximum(np.arange(1 << 16), 1) + 1)).astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    if values.max(initial=0) < 1 << 16:
        return SHORT_WIDTHS[values.astype(np.int64)]
    width = np.ones(values.shape, np.uint8)
    rest = values
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >> np.uint64(step)
        big = more > 0
        width += np.uint8(step) * big
        rest = np.where(big, more, rest)
    return width


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Words, the first word of each block, and the number of escapes."""
    n = len(values)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), 0
    blocks, room = -(-n // BLOCK), BLOCK + int(COUNTS.max())
    grid = np.zeros((blocks, room), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    width = _widths(grid)
    best = (width[:, :BLOCK] <= 60).astype(np.uint8)
    widest = width[:, :BLOCK].copy()
    for selector in range(2, LAST + 1):
        for j in range(int(COUNTS[selector - 1]), int(COUNTS[selector])):
            np.maximum(widest, width[:, j:j + BLOCK], out=widest)
        best += widest <= BITS[selector]  # what does not fit a selector fits none after it
    # where the words start: all blocks go on together, a word each time
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - BLOCK * (blocks - 1)
    step = COUNTS[best]
    starts = np.zeros((blocks, BLOCK), bool)
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(live):
        starts[live, at] = True
        at = at + step[live, at]
        on = at < sizes[live]
        live, at = live[on], at[on]
    block, place = np.nonzero(starts)
    selector = best[block, place]
    raw = selector == 0
    # and what they hold, by selector; values behind a block's end are zero
    slot = np.arange(len(selector)) + np.cumsum(raw) - raw  # an escape takes one word more
    out = np.zeros(len(selector) + int(raw.sum()), np.uint64)
    flat, at = grid.reshape(-1), block * room + place
    for s in np.flatnonzero(np.bincount(selector)):
        of = np.flatnonzero(selector == s)
        cells = at[of]
        if s == 0:
            out[slot[of] + 1] = flat[cells]
            continue
        word = np.full(len(of), np.uint64(s) << np.uint64(60))
        for j in range(int(COUNTS[s])):
            word |= flat[cells + j] << np.uint64(j * BITS[s])
        out[slot[of]] = word
    first = np.flatnonzero(np.diff(block, prepend=-1))
    return out, slot[first].astype(np.uint32), int(raw.sum())


def decode(words: np.ndarray, offsets: np.ndarray, n: int, escapes: int = 0) -> np.ndarray:
    """The ``n`` values of the blocks that start at ``offsets``."""
    if n == 0:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if escapes:  # a raw word may look like a selector: walk the blocks that have one
        ends = np.append(offsets[1:], len(words))
        for first, end in zip(offsets.tolist(), ends.tolist(), strict=True):
            at = first
            while at < end:
                if selector[at] == 0:
                    raw[at + 1] = True
                    at += 1
                at += 1
    count = np.where(raw, 0, COUNTS[np.where(raw, 1, selector)])
    block = np.zeros(len(words), np.int64)
    block[offsets[1:].astype(np.int64)] = 1
    block = np.cumsum(block)
    before = np.cumsum(count) - count
    place = before - before[offsets.astype(np.int64)][block] + block * (BLOCK + 60)
    grid = np.zeros(len(offsets) * (BLOCK + 60), np.uint64)
    for s in np.unique(selector[~raw]):
        at = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            grid[place[at]] = words[at + 1]
            continue
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        grid[place[at][:, None] + np.arange(COUNTS[s])] = (words[at][:, None] >> shift) & mask
    return grid.reshape(-1, BLOCK + 60)[:, :BLOCK].reshape(-1)[:n]
