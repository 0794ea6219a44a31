"""Periodic runs of words by Main and Lorentz's divide and conquer on interned word ids.

A run is a maximal stretch of words with smallest period q and at least ``LEAST_REPEATS`` times q words. Texts are cut in
halves again and again; a run crosses the midpoint of the smallest block that holds it, and as it has at least four periods, two of them stand on one
side: a square begins or ends at the midpoint. What the Z-function of a half says of a midpoint, how far its words repeat at
each distance, is asked for all midpoints of a level at once: distances at which the first words are equal, then hashes of one period against the next.
Squares are extended to whole runs by binary search over hashes, those that a smaller period explains are dropped (by Fine and Wilf's theorem all
that stand within its run), and the intervals that several midpoints find are united and compared word by word.

All texts of a step are one sequence, with a word of its own between each two, so no run crosses texts. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, mapped, single, steps, utf8
from .words import WORD_INV, WORD_P, Words, mix, rolled, window

#: Words are runs of bytes other than space and tab to carriage return.
KINDS = np.ones(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
SAME = np.arange(256, dtype=np.uint8)
LEAST_WORDS, LEAST_REPEATS = 6, 4
#: Bytes of text in a step; a longer text is a step of its own.
STEP_BYTES = 1 << 20


class Sequence:
    """Word ids with hashes of any range."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.sums = rolled(mix(ids.astype(np.uint64) + np.uint64(1)), WORD_P)

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i are those from j, by hash."""
        return window(self.sums, i, i + n, WORD_INV) == window(self.sums, j, j + n, WORD_INV)

    def extent(self, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches around i in which words p apart are equal: start and end."""
        ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        most_ahead, most_behind = len(self.ids) - i - p, i
        bit = 1 << max(0, int(max(most_ahead.max(), most_behind.max(), 1)).bit_length() - 1)
        while bit:
            more = ahead + bit
            at = np.flatnonzero(more <= most_ahead)
            at = at[self.same(i[at] + ahead[at], i[at] + ahead[at] + p[at], np.full(len(at), bit))]
            ahead[at] = more[at]
            more = behind + bit
            at = np.flatnonzero(more <= most_behind)
            from_ = i[at] - more[at]
            at = at[self.same(from_, from_ + p[at], np.full(len(at), bit))]
            behind[at] = more[at]
            bit >>= 1
        return i - behind, i + p + ahead

    def direct(self, i: int, p: int) -> tuple[int, int]:
        """``extent`` of one place, word by word."""
        differ = self.ids[:-p] != self.ids[p:]
        after, before = np.flatnonzero(differ[i:]), np.flatnonzero(differ[:i])
        return int(before[-1]) + 1 if len(before) else 0, (i + int(after[0]) if len(after) else len(differ)) + p

    def is_run(self, s: int, e: int, p: int) -> bool:
        """Whether words p apart are equal in [s, e), and no longer beyond it."""
        w = self.ids
        return (s == 0 or w[s - 1] != w[s - 1 + p]) and (e == len(w) or w[e] != w[e - p]) and np.array_equal(w[s : e - p], w[s + p : e])


def squares(grid: np.ndarray, half: int, *, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """(block, p) in order: distances p up to half / 2 at which the word at the midpoint (or before it) stands again, ahead of it (or before)."""
    most = half // 2
    if ahead:
        found = grid[:, half + 1 : half + 1 + most] == grid[:, half : half + 1]
    else:
        found = grid[:, half - 1 - most : half - 1][:, ::-1] == grid[:, half - 1 : half]
    block, p = np.nonzero(found)
    return block, p + 1


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in a sequence of ids (not negative), in order of start and period. ``repeats`` is at least 4, ``least`` at least 6."""
    n = len(ids)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    seq = Sequence(ids)
    padded = np.empty(max(8, 1 << (n - 1).bit_length()), np.int64)
    padded[:n], padded[n:] = ids, -1 - np.arange(len(padded) - n)
    got = []
    half = 4
    while half < n:
        grid = padded.reshape(-1, 2 * half)
        for ahead in (True, False):
            block, p = squares(grid, half, ahead=ahead)
            middle = half + 2 * half * block
            fits = middle + (2 * p if ahead else 0) <= n
            middle, p = middle[fits], p[fits]
            at = middle if ahead else middle - p
            twice = seq.same(at, at + p if ahead else at - p, p)
            middle, p = middle[twice], p[twice]
            while len(middle):  # the smallest distance of each midpoint; the next round has those that its run doesn't explain
                first = np.flatnonzero(np.r_[True, middle[1:] != middle[:-1]])
                m, q = middle[first], p[first]
                anchor = m if ahead else m - q
                s, e = seq.extent(anchor, q)
                long = e - s >= np.maximum(least, repeats * q)
                got.append(np.stack([s, e, q, anchor])[:, long])
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(middle))))
                within = middle + 2 * p <= e[owner] if ahead else middle - 2 * p >= s[owner]
                left = ~((p % q[owner] == 0) & within)
                left[first] = False
                middle, p = middle[left], p[left]
        half *= 2
    every = np.concatenate(got, axis=1) if got else np.zeros((4, 0), np.int64)
    _, one = np.unique(every[:3], axis=1, return_index=True)
    runs = set()
    for s, e, q, anchor in every[:, one].T.tolist():
        if not seq.is_run(s, e, q):  # hashes of different words were equal
            s, e = seq.direct(anchor, q)
            if e - s < max(least, repeats * q):
                continue
        runs.add((s, q, e))
    out = np.array(sorted(runs), np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def cycled(n: int, start: int | None, period: int | None) -> np.ndarray | None:
    """Which of n words each word becomes if those from ``start`` on repeat ``period`` of them; None if nothing changes."""
    if start is None or period is None or not 0 <= start < n or period < 1:
        return None
    out = np.arange(n)
    out[start:] = start + (out[start:] - start) % period
    return out


def collapse(raw: np.ndarray, words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of all texts, of the kept words only, with one space between them."""
    chosen = np.flatnonzero(kept)
    doc = words.doc(chosen)
    start, end = words.start[chosen].astype(np.int64), words.end[chosen].astype(np.int64)
    gap = end[:-1][doc[1:] == doc[:-1]]  # a byte between words
    change = np.zeros(len(raw) + 1, np.int8)
    change[start] += 1
    change[end] -= 1  # a word's end is never another's start
    inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    inside[gap] = True
    body = raw.copy()
    body[gap] = 32
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=count[1:])
    return body[inside], count[words.offsets]


def of_texts(raw: np.ndarray, offsets: np.ndarray, cycle: list[tuple[int | None, int | None]]) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its runs, as rows (start, length, period), and what remains of it."""
    words = Words(raw, offsets, kinds=KINDS, fold=SAME)
    first = np.asarray(words.first, np.int64)
    sizes = np.diff(first)
    _, ids = np.unique(words.hash, return_inverse=True)
    ids = ids.reshape(-1).astype(np.int64)
    moved = {d: m for d, (a, p) in enumerate(cycle) if (m := cycled(int(sizes[d]), a, p)) is not None}
    for d, m in moved.items():
        ids[first[d] : first[d + 1]] = ids[first[d] + m]
    n_docs, most = len(sizes), int(ids.max()) + 1 if len(ids) else 0
    place = np.arange(len(ids)) + np.repeat(np.arange(n_docs), sizes)
    line = np.full(len(ids) + n_docs, -1, np.int64)
    line[place] = ids
    line[line < 0] = most + np.arange(n_docs)  # a word of its own after each text
    start, end, period = find_runs(line)
    doc = np.searchsorted(first[:-1] + np.arange(n_docs), start, side="right") - 1
    kept = np.ones(len(ids), bool)
    if len(start):
        change = np.zeros(len(line) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[place] == 0
    rows = np.stack([start - first[doc] - doc, end - start, period], axis=1)
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    whole = kept.copy()
    for d in moved:
        whole[first[d] : first[d + 1]] = False
    body, ends = collapse(raw, words, whole)
    remains = [body[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for d, m in moved.items():
        at = first[d] + m[kept[first[d] : first[d + 1]]]
        remains[d] = b" ".join(raw[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True))
    return [rows[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], remains


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, *, text: str = "text", cycle: tuple[Column, Column] | None = None, runs: str = "_runs", collapsed: str = "_collapsed") -> DataFrame:
    """``docs`` with all runs of each whole text, an array of (start, length, period) in words by start and period, and its text without what repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte (through 64-bit hashes). A run has at least 6 words and 4 periods, and nothing beside it
    goes on with its period. The collapsed text has the words that no run holds after its first period, with one space between them.
    ``cycle`` gives, for texts that are to be read as if words repeated, the first word (from 0) and the period; where either is null or
    out of range, the text is read as it is. A text that is null, empty or without words has no runs and an empty collapsed text. Repeated rows have the same;
    other columns pass through, those named like a result are replaced.
    """
    from_, period = (F.lit(None), F.lit(None)) if cycle is None else cycle
    sealed = Sealed(docs.select(from_.cast("long").alias("-"), period.cast("long").alias("-"), "*"), runs, collapsed)
    (first, size), sealed.inner, sealed.names = sealed.inner[:2], sealed.inner[2:], sealed.names[2:]
    column, kept = sealed[text], sealed.inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, column))
            a, p = single(batch, first), single(batch, size)
            for i, j in steps(offsets, STEP_BYTES):
                part = raw[offsets[i] : offsets[j]]
                found, remains = of_texts(part, offsets[i : j + 1] - offsets[i], list(zip(a[i:j].to_pylist(), p[i:j].to_pylist(), strict=True)))
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"]))
                own = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(remains, pa.binary()).cast(pa.string())], names=[*kept, "_runs", "_collapsed"])

    fields = [f for f in sealed.df.schema.fields if f.name in kept]
    found = mapped(sealed.df, run, T.StructType([*fields, T.StructField("_runs", RUN), T.StructField("_collapsed", T.StringType())]))
    return sealed.open(found, **{runs: F.col("_runs"), collapsed: F.col("_collapsed")})
