"""Vectorised rolling hashes, sliding minima and word spans over UTF-8 bytes, for use inside Arrow tasks.

A document longer than BLOCK bytes is worked through in overlapping blocks by the callers, so the tables of
powers stay small however long a text is.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BLOCK = 1 << 19
#: Longer words are hashed by BLAKE2: a polynomial modulo 2**64 gives some words of 512 bytes and more one value for every base.
POLYNOMIAL_BYTES = 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables = [np.random.RandomState(seed).randint(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1) for seed in (11, 12)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, U(base))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        held = _powers[which] = (out[0], out[1])
    return held


class Rolling:
    """Hashes of any range of a sequence of 64-bit codes, after one prefix sum."""

    def __init__(self, codes: np.ndarray, which: int = 0) -> None:
        up, self.down = powers(which, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of a length, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + U(length)) if n > 0 else np.zeros(0, U)


def byte_codes(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _tables[which][data]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~WHITE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit code of every word, by BLAKE2 where it is long; blocks keep the tables of powers small."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        out[at:stop] = Rolling(byte_codes(data[low:high], which), which).ranges(starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of a width, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def minimizers(codes: np.ndarray, gram: int, window: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a length, the least of its grams: (position, least offset, greatest offset, hash).

    A window that starts at ``position - offset`` has its least gram there. Equal windows have theirs at
    equal offsets wherever they stand, so equal windows always share one (hash, offset).
    """
    found: list[tuple[np.ndarray, ...]] = []
    step = BLOCK - window
    mask = U((1 << 20) - 1)
    for low in range(0, max(1, len(codes) - window + 1), step):
        part = codes[low : low + step + window - 1]
        if len(part) < window:
            break
        grams = Rolling(part, which).windows(gram)
        order = (grams & ~mask) | np.arange(len(grams), dtype=U)
        at = (sliding_min(order, window - gram + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        here = at[first]
        found.append((here + low, here - last, here - first, grams[here]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U)
    pos, lo, hi, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # an anchor of windows on both sides of a block's border is one anchor
    first = np.flatnonzero(np.diff(pos, prepend=-1))
    last = np.append(first[1:], len(pos)) - 1
    return pos[first], lo[last], hi[first], h[first]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)
