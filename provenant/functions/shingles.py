"""Hashed character shingles, many texts at a time.

The same sets as ``text.char_shingles`` gives, as 64-bit hashes. Slices of strings in the JVM cost about a microsecond for
each character; here a text's characters are an array of code points and all its windows are hashed by six additions of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .text import SHINGLE

# White space of any script, and the marks that shingles leave out.
SPACES = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MARKS = "，。、；：（）()“”\"'【】《》"
FACTOR = 0x9E3779B97F4A7C15
#: Characters that are hashed at once, but for a longer text.
STEP = 1 << 19


DROPPED = np.array([*SPACES, *map(ord, MARKS)], np.uint32)


def hashes(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the runs of n characters of all texts in turn, and where those of each begin; none of a text with fewer."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(raw), np.uint32)
    doc = np.repeat(np.arange(len(raw)), [len(t) // 4 for t in raw])
    kept = ~np.isin(points, DROPPED)
    points, doc = points[kept].astype(np.uint64), doc[kept]
    count = max(len(points) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += points[k : k + count] * np.uint64(pow(FACTOR, k + 1, 1 << 64))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    inside = doc[:count] == doc[n - 1 :] if count else np.zeros(0, bool)
    out, doc = out[inside].view(np.int64), doc[:count][inside]
    ends = np.searchsorted(doc, np.arange(len(raw) + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(raw)))])


@F.pandas_udf(ArrayType(LongType()))
def _hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        rows = []
        held: list[str | None] = []
        size = 0
        for t in [*part, None]:  # some texts at a time
            if held and (len(rows) + len(held) == len(part) or size + len(t or "") > STEP):
                found, at = hashes(held)
                rows += [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                held, size = [], 0
            held.append(t)
            size += len(t or "")
        yield pd.Series(rows, index=part.index, dtype=object)


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``STEP`` characters together, but of one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > STEP:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


def with_shingles(texts: DataFrame, *, sets: bool = True) -> DataFrame:
    """(key, n, s) of a table (key, text): the number of distinct shingles of each text and, with ``sets``, their hashes. Rows leave as they are made, some texts at a time."""
    key, text = texts.columns
    names = [key, "n", "s"] if sets else [key, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in parts(every):
                found, ends = hashes(every[a:b])
                made = [batch.column(0).slice(a, b - a), pa.array(np.diff(ends), pa.int32())]
                yield pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))] if sets else made, names=names)

    return texts.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, n int" + (", s array<bigint>" if sets else ""))


def shingle_hashes(text: Column) -> Column:
    """Distinct hashed shingles of a text; null texts have none."""
    return _hashes(text)
