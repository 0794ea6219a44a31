"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items: 13 consecutive words, or the whole item if it has fewer (but some).
Patterns of one length m form a group with

* a shift table: for the hash of a block of two words, how far the search may jump because no pattern has
  that block nearer to its end (the table is a byte array indexed by hash bits; sharing a slot only shortens jumps);
* suffix buckets: where the shift is 0, the hash of the m words that end there selects the patterns to test;
* direct comparison: the words themselves are compared before an occurrence counts.

Documents are searched in lanes that jump in lockstep, so that each step is a NumPy operation.
The pattern tables are broadcast; items are split into blocks of at most ``MAX_BLOCK_BYTES`` of text for that,
and each block is a scan of its own over the documents, so the tables in memory are bounded for any benchmark.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, mapped, single, stage, steps, utf8
from .words import WORD_INV, WORD_P, Words, mix, rolled, window

WINDOW = 13
#: Benchmark text whose tables are broadcast together; tables take some 30 times as much.
MAX_BLOCK_BYTES = 4 << 20
LANE = 128
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Group:
    """The tables of all patterns of m words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set[int]], word_hash: dict[bytes, int]):
        self.m, self.block = m, min(2, m)
        self.texts = list(patterns)
        self.items = [sorted(patterns[p]) for p in self.texts]
        grid = np.array([[word_hash[w] for w in p] for p in self.texts], np.uint64).reshape(-1, m)
        flat, at = rolled(grid.ravel(), WORD_P), np.arange(len(grid)) * m
        hashes = window(flat, at, at + m, WORD_INV)
        order = np.argsort(hashes, kind="stable")
        self.texts, self.items = [self.texts[i] for i in order], [self.items[i] for i in order]
        self.hashes = hashes[order]
        self.bits = max(16, min(24, int(16 * len(grid) * m).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8)
        for end in range(self.block, m + 1):  # the block that ends after word `end`
            np.minimum.at(self.shift, self.slot(grid[:, end - 1], grid[:, end - 2] if self.block == 2 else None), m - end)

    def slot(self, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        x = last if before is None else last * np.uint64(3) + before
        return (mix(x) >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """First words of the places at which the shift is 0; ``bounds``: the first word of each text, and the end of the last."""
        m, n = self.m, len(hashes)
        slots = np.zeros(n, np.int64)
        if self.block == 2:
            slots[1:] = self.slot(hashes[1:], hashes[:-1])
        else:
            slots[:] = self.slot(hashes, None)
        jump = self.shift[slots].astype(np.int64)
        first, last = bounds[:-1], bounds[1:]
        span = np.maximum(last - first - (m - 1), 0)  # places where a window may end, for each document
        lanes = -(-span // LANE)
        doc = np.repeat(np.arange(len(span)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[doc] + m - 1 + nth * LANE
        stop = np.minimum(at + LANE, last[doc])
        found = []
        while len(at):
            move = jump[at]
            if (hit := move == 0).any():
                found.append(at[hit])
                move[hit] = 1
            at = at + move
            if not (on := at < stop).all():
                at, stop = at[on], stop[on]
        return np.concatenate(found) - (m - 1) if found else np.zeros(0, np.int64)

    def occurrences(self, words: Words, known: dict) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence, confirmed by comparing the words."""
        for low, high, bounds in words.parts(self.m - 1):
            yield from self.confirmed(words, self.candidates(words.hash[low:high], bounds) + low, known)

    def confirmed(self, words: Words, first: np.ndarray, known: dict) -> Iterator[tuple[int, int]]:
        """The occurrences among candidates."""
        hashes = words.grams(first, self.m)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        fits = self.hashes[at] == hashes
        for i, k in zip(first[fits].tolist(), at[fits].tolist(), strict=True):
            text = words.text(i, self.m)
            if (found := known.get((self.m, text))) is None:
                seen = tuple(WORD.findall(text))
                found = []
                for j in range(k, int(np.searchsorted(self.hashes, self.hashes[k], side="right"))):
                    if self.texts[j] == seen:
                        found.append(j)
                if len(known) > 100_000:
                    known.clear()
                known[self.m, text] = found
            for k in found:
                yield i, k


def build_groups(texts: list[str | None], n: int = WINDOW) -> list[Group]:
    """The groups of all windows of the items; a window carries the items it is in."""
    patterns: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for item, text in enumerate(texts):
        words = WORD.findall(re.sub(rb"[A-Z]+", lambda x: x[0].lower(), (text or "").encode()))
        m = min(n, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            patterns[m][tuple(words[i : i + m])].add(item)
    vocabulary = sorted({w for group in patterns.values() for p in group for w in p})
    raw, offsets = utf8(pa.array(vocabulary, pa.binary()))
    hashes = dict(zip(vocabulary, Words(raw, offsets).hash.tolist(), strict=True))
    return [Group(m, group, hashes) for m, group in sorted(patterns.items())]


def search(raw: np.ndarray, offsets: np.ndarray, groups: list[Group], known: dict) -> tuple[np.ndarray, list, list]:
    """For each text: number of words, hit spans [start, end) in words, and the items that occur."""
    words = Words(raw, offsets)
    n = len(offsets) - 1
    items: list[set[int]] = [set() for _ in range(n)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for group in groups:
        d = 0
        for i, k in group.occurrences(words, known):
            if not words.first[d] <= i < words.first[d + 1]:
                d = int(words.doc(i))
            items[d].update(group.items[k])
            at, mine = i - int(words.first[d]), spans[d]
            if mine and mine[-1][0] <= at <= mine[-1][1]:  # occurrences in order grow a span
                mine[-1] = (mine[-1][0], max(mine[-1][1], at + group.m))
            else:
                mine.append((at, at + group.m))
    return np.diff(words.first), [joined(x) for x in spans], items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def _pass(docs: DataFrame, text: str, groups: list[Group], ids: list[str], only_found: bool = False) -> DataFrame:
    """``docs`` with the struct column _found, for one block of items; ``only_found``: only (_rid, _found) of texts with occurrences."""
    tables = docs.sparkSession.sparkContext.broadcast((groups, ids))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, ids = tables.value
        known: dict = {}
        for batch in batches:
            raw, offsets = utf8(single(batch, text))
            out = []
            for i, j in steps(offsets):
                lengths, spans, items = search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], groups, known)
                out += [{"n_words": int(n), "spans": [{"start": a, "end": b} for a, b in s], "items": [ids[k] for k in sorted(x)]} for n, s, x in zip(lengths, spans, items, strict=True)]
            columns, names = batch.columns, batch.schema.names
            if only_found:
                some = pa.array([i for i, x in enumerate(out) if x["items"]], pa.int64())
                out, columns, names = [x for x in out if x["items"]], [single(batch, "_rid").take(some)], ["_rid"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*names, "_found"])

    fields = [T.StructField("_rid", T.LongType())] if only_found else docs.schema.fields
    return mapped(docs, run, T.StructType([*fields, T.StructField("_found", FOUND)]))


def merged(spans: Column) -> Column:
    """Sorted disjoint spans that cover what ``spans`` cover."""
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["end"]),
        F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(done, F.array(x)))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), empty, step))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", found: str = "_found", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``found``: n_words, spans (sorted, disjoint, in words), items (sorted, distinct strings).

    A null or wordless text has no words, spans or items; so has every text if the benchmark is empty or has no words.
    Items with a null id count as an item named by the empty string; repeated ids are one item. Repeated
    documents are searched each by itself. Other columns pass through; one named ``found`` is replaced.

    With several blocks of items the documents are staged once under row numbers; each further block is a scan of them that writes
    only what it finds, and all that was found is joined at the end.
    """
    sealed = Sealed(docs, found)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // max_block_bytes) or 1

    def tables(k: int) -> tuple[list[Group], list[str]]:
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        rows = part.distinct().collect()  # the texts of one block: bounded by max_block_bytes, on average over the hash
        return build_groups([r["t"] for r in rows]), [r["id"] for r in rows]

    if blocks == 1:
        out, spans, names = _pass(sealed.df, sealed[text], *tables(0)), F.col("_found")["spans"], F.col("_found")["items"]
    else:
        numbered = stage(sealed.df.withColumn("_rid", F.monotonically_increasing_id()), "decontaminate")
        slim = numbered.select("_rid", sealed[text])
        more = stage(slim.limit(0).select("_rid", F.lit(None).cast(FOUND).alias("_found")), "decontaminate-found")
        for k in range(1, blocks):
            more = more.unionByName(stage(_pass(slim, sealed[text], *tables(k), only_found=True), "decontaminate-found"))
        more = more.groupBy(F.col("_rid").alias("_other")).agg(F.flatten(F.collect_list("_found.spans")).alias("_spans"), F.flatten(F.collect_list("_found.items")).alias("_items"))
        first = _pass(numbered, sealed[text], *tables(0))
        out = first.join(more, F.col("_rid") == F.col("_other"), "left")
        spans = merged(F.concat("_found.spans", F.coalesce("_spans", F.array().cast(SPANS))))
        names = F.concat("_found.items", F.coalesce("_items", F.array().cast("array<string>")))
    tidy = F.struct(F.col("_found")["n_words"].alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(names)).alias("items"))
    return sealed.open(out, **{found: tidy})


def hit_words(found: str = "_found") -> Column:
    """Number of hit words."""
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated(found: str = "_found") -> Column:
    """At least one hit word, and at least one in twenty."""
    return (hit_words(found) > 0) & (hit_words(found) * 20 >= F.col(found)["n_words"])
