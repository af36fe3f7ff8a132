"""Simple-8b: word-aligned packing of non-negative integers.

A 64-bit word holds a 4-bit selector (the high bits) and as many equal-width values as fit. Runs of
zeros take no payload. A value that needs more than 60 bits is an escape: selector 15 (one value of 60
bits) holds its low 60 bits, and the pair (position, high bits) goes to the block's escape list.

A block: header of four little-endian uint32 (values, words, escapes, 0), the words, then the escapes
as pairs of uint64. Blocks are independent, so a reader can begin at any block.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values held by a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Stretches that are filled one by one rather than together (speed only).
FEW = 256
_LOW60 = np.uint64((1 << 60) - 1)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For every position the first (densest) selector whose word could begin there."""
    n = len(bits)
    best = np.full(n, 15, np.int8)
    upto = np.cumsum(np.bincount(bits, minlength=62))
    for s in range(14, -1, -1):
        k, w = COUNTS[s], WIDTHS[s]
        if upto[w] < k:
            continue
        bad = np.concatenate([[-1], np.flatnonzero(bits > w), [n]])
        gap = np.flatnonzero(np.diff(bad) > k)  # stretches in which a whole word fits
        first, many = bad[gap] + 1, bad[gap + 1] - bad[gap] - k
        if len(gap) <= FEW:
            for a, m in zip(first.tolist(), many.tolist(), strict=True):
                best[a : a + m] = s
            continue
        best[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())] = s
    return best


def encode_block(values: np.ndarray) -> bytes:
    """One block of uint64 values (any length, also zero)."""
    values = np.ascontiguousarray(values, np.uint64)
    high = np.flatnonzero(values >> np.uint64(60))
    escapes = np.stack([high.astype(np.uint64), values[high] >> np.uint64(60)], 1) if len(high) else np.zeros((0, 2), np.uint64)
    low = values & _LOW60
    if len(low) and low.max() < 1 << 24:
        bits = np.frexp(low.astype(np.float32))[1].astype(np.int8)  # exact up to 2**24
    elif len(low) and low.max() < 1 << 52:
        bits = np.frexp(low.astype(np.float64))[1].astype(np.int8)  # exact below 2**53
    else:
        bits = np.array([int(x).bit_length() for x in low], np.int8)
    best = _selectors(bits)
    steps = np.asarray(COUNTS, np.int64)[best].tolist()
    starts, at, n = [], 0, len(low)
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.asarray(starts, np.int64)
    chosen = best[starts] if len(starts) else np.zeros(0, np.int8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            part = low[starts[rows][:, None] + np.arange(COUNTS[s])]
            words[rows] |= np.bitwise_or.reduce(part << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])), axis=1)
    head = np.asarray([n, len(words), len(escapes), 0], "<u4")
    return head.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The uint64 values of a block."""
    n, n_words, n_escapes, _ = np.frombuffer(data, "<u4", 4).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, 16)
    escapes = np.frombuffer(data, "<u8", 2 * n_escapes, 16 + 8 * n_words).reshape(-1, 2)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    held = np.asarray(COUNTS, np.int64)[chosen]
    starts = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            part = (words[rows][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s]))) & mask
            out[starts[rows][:, None] + np.arange(COUNTS[s])] = part
    if len(out) < n:
        raise ValueError("the block is cut short")
    out = out[:n]
    out[escapes[:, 0].astype(np.int64)] |= escapes[:, 1] << np.uint64(60)
    return out
