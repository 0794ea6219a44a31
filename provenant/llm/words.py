"""Vectorised words, word hashes and word-window hashes over UTF-8 bytes.

A word is a run of digits, letters and characters beyond ASCII, with A-Z lower-cased:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every byte of a character beyond ASCII is at least 0x80,
so bytes can be classed one by one.

All loops take ``PART`` entries at a time and tables of powers have a fixed length, so temporaries stay small for a text of any
length; what is kept are 16 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True

#: Odd multipliers of the rolling hashes, and their inverses modulo 2**64.
BYTE_P, WORD_P = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BYTE_INV, WORD_INV = pow(BYTE_P, -1, 1 << 64), pow(WORD_P, -1, 1 << 64)
#: Entries that a loop takes at a time, and of a table of powers: a power of 2.
PART = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def power(base: int, n: int) -> np.uint64:
    """base**n modulo 2**64."""
    return np.uint64(pow(base, n, 1 << 64))


@lru_cache(maxsize=8)
def _powers(base: int) -> np.ndarray:
    """base**0 .. base**(PART-1) modulo 2**64."""
    out = np.ones(PART, np.uint64)
    n = 1
    while n < PART:
        out[n : 2 * n] = out[:n] * power(base, n)
        n *= 2
    return out


def powers(base: int, at: np.ndarray) -> np.ndarray:
    """base to each of some exponents below PART**2, modulo 2**64."""
    out = _powers(base)[at & (PART - 1)]
    high = at // PART
    return out * _powers(int(power(base, PART)))[high] if len(high) and high.max() else out


def rolled(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums with which ``window`` hashes any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    for a in range(0, len(values), PART):
        part = values[a : a + PART]
        sums = np.cumsum(part * _powers(base)[: len(part)], dtype=np.uint64)
        out[a + 1 : a + 1 + len(part)] = sums * power(base, a) + out[a] if a else sums
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int) -> np.ndarray:
    """Hash of the values in [start, end), whatever their place."""
    return mix((sums[end] - sums[start]) * powers(inverse, start) + (end - start).astype(np.uint64))


def windows(sums: np.ndarray, n: int, inverse: int) -> np.ndarray:
    """Hash of every n consecutive values: ``window`` for all starts in turn."""
    out = sums[n:] - sums[:-n]
    for a in range(0, len(out), PART):
        part = out[a : a + PART]
        part *= _powers(inverse)[: len(part)] * power(inverse, a)
        part[:] = mix(part + np.uint64(n))
    return out


def ranges(n: int, values: Callable[[int, int], np.ndarray], bounds: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Hash of the values from each of some ascending bounds to the next, as ``window`` gives it; ``values(a, b)`` gives some of the n."""
    at = np.zeros(len(bounds), np.uint64)
    before = np.zeros(1, np.uint64)  # an array: scalars warn of overflow
    for a in range(0, max(n, 1), PART):
        sums = rolled(values(a, min(a + PART, n)), base)
        i, j = np.searchsorted(bounds, [a, a + PART])
        scale = power(base, a)
        at[i:j] = before + sums[np.minimum(bounds[i:j] - a, len(sums) - 1)] * scale
        before = before + sums[-1:] * scale
    at[bounds >= n] = before[0]
    return mix((at[1:] - at[:-1]) * powers(inverse, bounds[:-1]) + np.diff(bounds).astype(np.uint64))


class Words:
    """The words of several texts: byte ranges, 64-bit hashes, first word of each text.

    ``kinds`` of bytes: 0 stands between words; one also starts where kind 2 follows kind 1. With ``second``, a base, there is a second hash.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, *, kinds: np.ndarray = IN_WORD.view(np.uint8), fold: np.ndarray = LOWER, second: int = 0):
        self.raw, self.offsets = raw, offsets
        bases = [BYTE_P, second][: 2 if second else 1]
        small = np.int32 if len(raw) < 1 << 31 else np.int64
        cuts = offsets[1:-1]
        # room for the most words there may be: pages that none come to are never touched
        starts, ends, hashes, n_words = np.empty(len(raw), small), np.empty(len(raw), small), [np.empty(len(raw), np.uint64) for _ in bases], 0
        open_, open_sum = np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in bases]  # the word that the next part goes on with
        before = [np.zeros(1, np.uint64) for _ in bases]  # arrays: scalars warn of overflow
        for a in range(0, len(raw), PART):
            part = raw[a : a + PART]
            kind = kinds[part]
            prior = np.empty_like(kind)
            prior[0], prior[1:] = kinds[raw[a - 1]] if a else 0, kind[:-1]
            inside = kind > 0
            begin = inside & ((prior == 0) | ((kind == 2) & (prior == 1)))
            i, j = np.searchsorted(cuts, [max(a, 1), a + len(part)])
            begin[cuts[i:j] - a] = inside[cuts[i:j] - a]  # words never cross texts
            stop = (prior > 0) & (begin | ~inside)
            s, e = np.flatnonzero(begin), np.flatnonzero(stop)
            if a + len(part) == len(raw) and inside[-1]:
                e = np.append(e, len(part))
            start = np.concatenate([open_, s + a])
            k = len(e)
            size = e + a - start[:k]
            values = fold[part].astype(np.uint64) + np.uint64(1)
            for n, base in enumerate(bases):
                sums = rolled(values, base)
                scale = power(base, a)
                at_start = np.concatenate([open_sum[n], before[n] + sums[s] * scale])
                hashes[n][n_words : n_words + k] = mix((before[n] + sums[e] * scale - at_start[:k]) * powers(pow(base, -1, 1 << 64), start[:k]) + size.astype(np.uint64))
                open_sum[n], before[n] = at_start[k:], before[n] + sums[-1:] * scale
            starts[n_words : n_words + k], ends[n_words : n_words + k] = start[:k], e + a
            n_words += k
            open_ = start[k:]
        self.start, self.end = starts[:n_words], ends[:n_words]
        self.hash, *more = (h[:n_words] for h in hashes)
        self.other = more[0] if more else None
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end of the last

    def __len__(self) -> int:
        return len(self.start)

    def doc(self, word: np.ndarray) -> np.ndarray:
        """Which text each of some words is in."""
        return np.searchsorted(self.first, word, side="right") - 1

    def grams(self, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Hashes of the runs of n words from each of ``first``."""
        if not len(first):
            return np.zeros(0, np.uint64)
        end = first + n
        low, high = int(first.min()), int(end.max())
        return window(rolled(self.hash[low:high], WORD_P), first - low, end - low, WORD_INV)

    def whole(self) -> np.ndarray:
        """A hash of all words of each text, in order."""
        return ranges(len(self), lambda a, b: self.hash[a:b], self.first, WORD_P, WORD_INV)

    def parts(self, overlap: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, first word of each text within [a, b), from a): PART words at a time, and the ``overlap`` words before them."""
        for a in range(0, len(self), PART):
            low, high = max(0, a - overlap), min(a + PART, len(self))
            yield low, high, np.clip(self.first, low, high) - low

    def text(self, first: int, n: int) -> bytes:
        """The bytes from a word's start to the end of the n-th from it, lower-cased."""
        return LOWER[self.raw[self.start[first] : self.end[first + n - 1]]].tobytes()
