"""Removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut the corpus into phrases: a position is a trigger if the hash of the ``gram`` bytes at it is the least
among those of ``spread`` consecutive positions (of equal ones the last). Where a string repeats, so do its triggers, so any two
equal strings of ``size`` bytes have their first trigger at the same offset, and a trigger stands for the strings whose
first trigger it is: those that start in a run of positions before it.

* Dictionary: triggers are grouped by the fingerprint of the bytes that all their strings share. Most occur once and end here.
* Parse: of the others, those whose whole context (all their strings together) is equal are a class. With two triggers or
  more in a class, all their strings repeat. This settles the inside of copies, whatever their number.
* What is left are the edges of copies. One context for each class is fetched; within a group of contexts the strings
  are put in order and equal neighbours found. Groups of more than ``GROUP`` classes do this with a distributed aggregation instead.

Strings are compared by 64-bit fingerprints with their length and offset, never gathered: the corpus order of a
suffix array is kept only as far as equality at ``size`` bytes needs it, since a suffix array of the whole corpus has
no distributed form of bounded memory (README has figures). Copies of any number are summed with partial aggregates.

The same parse over words instead of bytes finds documents that hold a passage of some words that another document holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, broadcast_if_small, discard, mapped, single, stage, steps, utf8
from .ngrams import grouped
from .words import BYTE_INV, BYTE_P, WORD_INV, WORD_P, Words, mix, rolled, window, windows

SIZE, PASSAGE_WORDS = 400, 51
#: Bytes of text, and starts of strings, whose triggers are looked for at once; some 100 bytes of temporaries for each.
PARSE_BYTES = 1 << 18
#: Bits of a position within a step.
PLACE = 28
#: Classes of a group whose contexts a task compares by itself.
GROUP = 256
#: A document: two hashes of its key and text.
KEY = ["_d", "_e"]
#: A run of starts as one number: its first start times this, and how many more there are (fewer than this).
RUN = 512


@dataclass(frozen=True)
class Unit:
    """What strings are made of. ``elements``: those of some texts, given bytes and offsets, with their offsets."""

    size: int
    gram: int
    spread: int  # a power of 2; gram + spread are at most the size
    base: int
    inverse: int
    elements: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    dtype: type

    def sums(self, elements: np.ndarray) -> np.ndarray:
        return rolled(elements.astype(np.uint64) + np.uint64(1), self.base)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(raw, offsets)
    return words.hash, words.first


def of_bytes(size: int = SIZE) -> Unit:
    """Strings of ``size`` bytes."""
    if size < 272:
        raise ValueError("size must be at least 272")
    return Unit(size, 16, 256, BYTE_P, BYTE_INV, lambda raw, offsets: (raw, offsets), np.uint8)


def of_words(size: int = PASSAGE_WORDS) -> Unit:
    """Strings of ``size`` words."""
    if size < 34:
        raise ValueError("size must be at least 34")
    return Unit(size, 2, 32, WORD_P, WORD_INV, _words, np.uint64)


def triggers(elements: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """For each trigger: text, first and last start of its strings (from the text's start), the two fingerprints."""
    size, spread = unit.size, unit.spread
    starts_of = np.maximum(np.diff(offsets) - size + 1, 0)
    if not starts_of.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = unit.sums(elements)
    code = windows(sums, unit.gram, unit.inverse)
    code >>= np.uint64(PLACE)
    code <<= np.uint64(PLACE)
    code |= ((1 << PLACE) - 1 - np.arange(len(code))).astype(np.uint64)
    step = 1
    while step < spread:
        code = np.minimum(code[:-step], code[step:])
        step *= 2
    doc = np.repeat(np.arange(len(starts_of)), starts_of)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(starts_of) - starts_of - offsets[:-1], starts_of)
    place = ((1 << PLACE) - 1) - (code[start] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    q, low, high, doc = place[first], start[first], start[last], doc[first]
    shared = window(sums, q, q + size - spread + 1, unit.inverse)
    whole = mix(window(sums, low, high + size, unit.inverse) + (q - low).astype(np.uint64))
    base = offsets[:-1][doc]
    return doc, low - base, high - base, shared.view(np.int64), whole.view(np.int64)


def all_triggers(raw: np.ndarray, offsets: np.ndarray, unit: Unit, most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """``triggers`` of some texts; those of a long one are found for some starts at a time, with what stands around them."""
    most = most or PARSE_BYTES
    elements, offsets = unit.elements(raw, offsets)
    if len(elements) <= 2 * most:
        yield triggers(elements, offsets, unit)
        return
    for n in range(len(offsets) - 1):
        text = elements[offsets[n] : offsets[n + 1]]
        for a in range(0, max(len(text), 1), most):
            low = max(0, a - unit.spread)  # a run of starts is at most the spread
            part = text[low : a + most + unit.spread + unit.size]
            doc, x, y, f, f2 = triggers(part, np.array([0, len(part)]), unit)
            own = (x + low >= a) & (x + low < a + most)
            yield doc[own] + n, x[own] + low, y[own] + low, f[own], f2[own]


def told_once(doc: np.ndarray, low: np.ndarray, high: np.ndarray, f: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """One trigger of each context of a text, how many there are (2 for more), and the runs of starts (text, low, high) of contexts that stand in a text several times.

    A text that repeats a word over and over has a trigger at every repeat; all their strings repeat, and together they are few long runs.
    """
    order = np.lexsort((f2, f, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (f[order][1:] != f[order][:-1]) | (f2[order][1:] != f2[order][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(size > 1, size)
    doc, low, high = doc[again], low[again], high[again]
    begin = np.ones(len(doc), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | (low[1:] != high[:-1] + 1)
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return order[at], np.minimum(size, 2), (doc[first], low[first], high[last])


def _parse(docs: DataFrame, unit: Unit) -> DataFrame:
    """A row for each context of a text: _d, _e, at (the run of its strings' starts), f, f2, n (2 if it stands there more than once); staged.

    Rows with null f are runs of starts whose strings repeat within the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, "_t"))
            for i, j in steps(offsets, PARSE_BYTES):
                for doc, low, high, f, f2 in all_triggers(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit):
                    one, n, (whose, a, b) = told_once(doc, low, high, f, f2)
                    cuts = (b - a) // (RUN - 1) + 1  # a run of one number is shorter than RUN
                    whose, a, b = (np.repeat(x, cuts) for x in (whose, a, b))
                    a = a + (np.arange(len(a)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * (RUN - 1)
                    b = np.minimum(b, a + RUN - 2)
                    none = np.concatenate([np.zeros(len(one), bool), np.ones(len(a), bool)])
                    both = lambda x, z: np.concatenate([x, np.zeros(len(z), np.int64)])
                    keys = [single(batch, k).slice(i, j - i).take(pa.array(np.concatenate([doc[one], whose]))) for k in KEY]
                    at = np.concatenate([low[one] * RUN + high[one] - low[one], a * RUN + b - a])
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(at), pa.array(both(f[one], a), mask=none), pa.array(both(f2[one], a), mask=none), pa.array(both(n, a))], names=[*KEY, "at", "f", "f2", "n"])

    return stage(mapped(docs, run, "_d long, _e long, at long, f long, f2 long, n long"), "triggers")


def _contexts(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The contexts of ``wanted`` triggers (_d, _e, at, f): _d, _e, f, low, ctx (elements, as bytes)."""
    lists = stage(wanted.groupBy(*KEY).agg(F.collect_list(F.struct("f", "at")).alias("w")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, "_t"))
            for i, j in steps(offsets, PARSE_BYTES):
                elements, bounds = unit.elements(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for n, want in enumerate(single(batch, "w").slice(i, j - i).to_pylist()):
                    for at, f in {w["at"]: w["f"] for w in want}.items():
                        low, more = divmod(at, RUN)
                        rows.append((i + n, f, low, elements[bounds[n] + low : bounds[n] + low + more + unit.size].tobytes()))
                if rows:
                    doc, f, low, context = zip(*rows, strict=True)
                    keys = [single(batch, k).take(pa.array(doc)) for k in KEY]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(f, pa.int64()), pa.array(low, pa.int64()), pa.array(context, pa.binary())], names=[*KEY, "f", "low", "ctx"])

    # rows that are repeated give their contexts again, which changes nothing: all that they hold stands elsewhere, and they are one document
    found = docs.join(lists, KEY).select(*KEY, "_t", "w")
    out = stage(mapped(found, run, "_d long, _e long, f long, low long, ctx binary"), "contexts")
    discard(lists)
    return out


def _strings(table: pa.Table, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of all contexts: row, place in the context, fingerprint."""
    raw, offsets = utf8(table["ctx"].combine_chunks())
    elements, offsets = np.ascontiguousarray(raw).view(unit.dtype), offsets // np.dtype(unit.dtype).itemsize
    many = np.diff(offsets) - unit.size + 1
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = offsets[:-1][row] + place
    prints = window(unit.sums(elements), at, at + unit.size, unit.inverse)
    return row, place, mix(prints + table["f"].to_numpy().view(np.uint64)[row])


def _edges(contexts: DataFrame, unit: Unit) -> DataFrame:
    """Runs of starts of strings that contexts of one group have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in grouped(batches, ("f",), 500):
            row, place, prints = _strings(table, unit)
            order = np.argsort(prints, kind="stable")
            ordered = prints[order]
            same = ordered[1:] == ordered[:-1]
            twice = np.zeros(len(prints), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            rise, fall = twice.copy(), twice.copy()
            apart = row[1:] != row[:-1]
            rise[1:] &= ~twice[:-1] | apart
            fall[:-1] &= ~twice[1:] | apart
            a, b = np.flatnonzero(rise), np.flatnonzero(fall)
            low = table["low"].to_numpy()[row[a]]
            keys = [table[k].combine_chunks().take(pa.array(row[a])) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array((low + place[a]) * RUN + place[b] - place[a])], names=[*KEY, "at"])

    return mapped(contexts.select(*KEY, "f", "low", "ctx").repartition("f").sortWithinPartitions("f"), run, "_d long, _e long, at long")


def _all_strings(contexts: DataFrame, unit: Unit) -> DataFrame:
    """A row for each string of the contexts: _d, _e, at (a run of one start), p (its fingerprint); staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(0, table.num_rows, 500):
                part = table.slice(i, 500)
                row, place, prints = _strings(part, unit)
                keys = [part[k].combine_chunks().take(pa.array(row)) for k in KEY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array((part["low"].to_numpy()[row] + place) * RUN), pa.array(prints.view(np.int64))], names=[*KEY, "at", "p"])

    return stage(mapped(contexts.select(*KEY, "f", "low", "ctx"), run, "_d long, _e long, at long, p long"), "strings")


def _covered(runs: list[int], size: int) -> list[tuple[int, int]]:
    """Sorted disjoint byte spans of strings that start in the given runs."""
    out: list[list[int]] = []
    for low, more in (divmod(at, RUN) for at in sorted(runs)):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], low + more + size)
        else:
            out.append([low, low + more + size])
    return [(a, b) for a, b in out]


def document(key: Column, text: Column) -> dict[str, Column]:
    """What tells documents apart: _d and _e, two hashes of key and text."""
    key, text = key.cast("string"), F.coalesce(text, F.lit(""))
    return {"_d": F.xxhash64(text, key), "_e": F.xxhash64(F.lit(1), key, text)}


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with _d, _e and _t (the text, null as empty)."""
    return docs.withColumns(document(F.col(key), F.col(text)) | {"_t": F.coalesce(F.col(text), F.lit(""))})


def _classes(again: DataFrame, *more: Column) -> DataFrame:
    """Triggers of one context, with one of them: f, f2, mixed, _d, _e, at, and further aggregates."""
    one = [F.min("_d").alias("_d"), F.min_by("_e", "_d").alias("_e"), F.min_by("at", "_d").alias("at")]
    return again.groupBy("f", "f2").agg(F.first("mixed").alias("mixed"), *one, *more)


def passage_holders(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """(_d, _e) of the documents (``document``) that hold ``words`` consecutive words that another document holds too; staged.

    Rows with equal key and text are one document; null keys are equal. Nothing is removed.
    """
    unit = of_words(words)
    rows = _keyed(docs, key, text).select(*KEY, "_t")
    parsed = _parse(rows, unit)
    several = F.min("_d") != F.max("_d")
    groups = parsed.where("f is not null").groupBy("f").agg((F.min("f2") != F.max("f2")).alias("mixed"), several.alias("several")).where("several").select("f", "mixed")
    groups = stage(groups, "groups")
    again = stage(parsed.join(groups, "f"), "again")
    discard(parsed, groups)
    classes = stage(_classes(again, several.alias("several")), "classes")
    whole = stage(again.join(classes.where("several").select("f", "f2"), ["f", "f2"]).select(*KEY).distinct(), "holders")
    contexts = _contexts(rows, classes.where("mixed").select(*KEY, "at", "f"), unit)
    strings = _all_strings(contexts, unit)
    met = stage(strings.groupBy("p").agg(several.alias("several")).where("several").select("p"), "met")
    out = stage(whole.union(strings.join(met, "p").select(*KEY)).distinct(), "holders")
    discard(again, classes, whole, contexts, strings, met)
    return out


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, spans: str = "_removed", kept: str = "_kept") -> DataFrame:
    """``docs`` with the removed byte spans (sorted, disjoint, end exclusive) and the remaining bytes.

    A byte goes if a string of ``size`` bytes (272 or more) that covers it starts anywhere else too, in any row or the same one;
    strings don't cross rows. Null texts are empty; texts shorter than ``size`` keep everything. Repeated rows are copies of each
    other, whatever their key; keys may be null or repeated. Other columns pass through; those named ``spans`` or ``kept`` are replaced.
    """
    unit = of_bytes(size)
    sealed = Sealed(docs, spans, kept)
    keyed = _keyed(sealed.df, sealed[key], sealed[text])
    rows = keyed.select(*KEY, "_t")
    parsed = _parse(rows, unit)
    groups = parsed.where("f is not null").groupBy("f").agg(F.sum("n").alias("n"), (F.min("f2") != F.max("f2")).alias("mixed")).where("n > 1").select("f", "mixed")
    groups = stage(groups, "groups")
    again = stage(parsed.join(groups, "f"), "again")
    within = stage(parsed.where("f is null").select(*KEY, "at"), "within")
    discard(parsed, groups)
    classes = stage(_classes(again, F.sum("n").alias("n")), "classes")
    inside = again.join(classes.where("n > 1").select("f", "f2"), ["f", "f2"]).select(*KEY, "at")
    edge = classes.where("mixed").select(*KEY, "at", "f")
    contexts = _contexts(rows, edge, unit)
    many = broadcast_if_small(large := stage(edge.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("f"), "large-groups"))
    strings = _all_strings(contexts.join(many, "f", "left_semi"), unit)
    twice = stage(strings.groupBy("p").agg(F.count("*").alias("n")).where("n > 1").select("p"), "twice")
    edges = _edges(contexts.join(many, "f", "left_anti"), unit).union(strings.join(twice, "p").select(*KEY, "at"))
    ranges = stage(inside.union(edges).union(within).groupBy(*KEY).agg(F.collect_set("at").alias("_runs")), "ranges")
    discard(again, within, classes, contexts, large, strings, twice)

    inner = sealed.inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            raw, offsets = utf8(single(batch, "_t"))
            gone, left = [], []
            for n, starts in enumerate(single(batch, "_runs").to_pylist()):
                data = raw[offsets[n] : offsets[n + 1]]
                cut = _covered(starts or [], size)
                gone.append([{"start": a, "end": b} for a, b in cut])
                left.append(b"".join(data[a:b].tobytes() for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([*(single(batch, c) for c in inner), pa.array(gone, kind), pa.array(left, pa.binary())], names=[*inner, "_removed", "_kept"])

    joined = keyed.join(ranges, KEY, "left").select(*inner, "_t", "_runs")
    gone = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*sealed.df.schema.fields, T.StructField("_removed", gone), T.StructField("_kept", T.BinaryType())])
    return sealed.open(mapped(joined, run, schema), **{spans: F.col("_removed"), kept: F.col("_kept")})
