"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are compared by their sets of five-word shingles (all words as one shingle where there are fewer).

1. Texts with the same words are one class; only classes are compared from here on.
2. Each class has a MinHash signature. Classes that agree in a band of it are candidates. Large buckets are split into
   blocks, and a task compares two blocks (or one with itself).
3. A pair's MinHash values are compared some at a time; once the posterior probability that its similarity reaches the
   threshold, given the agreements so far and a uniform prior, is below ``TOLERANCE``, the pair is dropped.
   A pair counts only in the first band in which it agrees.
4. What is left links classes to candidate groups; a task gives a spanning forest of its pairs rather than the pairs.
5. Within groups, again in blocks, shingle sets are intersected exactly. A task gives the number of links of each class
   and a spanning forest of them. Components of the forests are the groups of near copies.

So no step emits all pairs of a bucket or a group, and none is capped. A pair at the threshold is missed by all bands
with a probability of 3e-6, and by pruning with 1e-9.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, broadcast_if_small, discard, mapped, single, stage, steps, utf8
from .components import components, local_components
from .words import PART, WORD_INV, WORD_P, Words, mix, ranges

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, CHUNK, TOLERANCE = 24, 4, 16, 1e-9
HASHES = BANDS * ROWS
#: Classes of a block, and pairs that are compared at once.
BLOCK, PAIRS = 512, 1 << 17
_RANDOM = np.random.default_rng(20240229)
FACTOR = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64) | np.uint64(1)
SHIFT = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)


def shingles(words: Words, n: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of the shingles of all texts in turn, with repeats, PART at a time: first text, one after the last, hashes, offset of each text's first."""
    count = np.diff(words.first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per)])
    for a in range(0, int(first[-1]), PART):
        b = min(a + PART, int(first[-1]))
        i, j = int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, b))
        mine = np.diff(np.clip(first[i : j + 1], a, b))
        at = np.repeat(words.first[i:j] - first[i:j], mine) + np.arange(a, b)
        yield i, j, words.grams(at, np.repeat(np.minimum(count[i:j], n), mine)), np.concatenate([[0], np.cumsum(mine)])


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * (len(words.first) - 1)
    for i, j, grams, first in shingles(words):
        for k in range(i, j):
            part = np.unique(grams[first[k - i] : first[k - i + 1]])
            sets[k] = np.union1d(sets[k], part) if len(sets[k]) else part
    return sets


def signatures(words: Words) -> np.ndarray:
    """A row of MinHash values (uint32) for each text; all ones for a text without shingles."""
    out = np.full((len(words.first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    for i, j, grams, first in shingles(words):
        some = np.flatnonzero(np.diff(first))
        for k in range(HASHES):
            least = np.minimum.reduceat(((grams * FACTOR[k] + SHIFT[k]) >> np.uint64(32)).astype(np.uint32), first[some])
            out[i + some, k] = np.minimum(out[i + some, k], least)
    return out


def need(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of values compared (CHUNK, 2 CHUNK ..): the least agreements with which a pair stays."""
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def describe(docs: DataFrame, text: str) -> DataFrame:
    """All columns of ``docs``, and _rid, _h1, _h2 (hashes of the words in order), _n (words), _sig; staged."""
    kept = docs.withColumn("_rid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, text))
            parts = []
            for i, j in steps(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                other = ranges(len(words), lambda a, b, w=words: mix(w.hash[a:b] + np.uint64(0x51ED270B)), words.first, WORD_P, WORD_INV)
                parts.append((words.whole().view(np.int64), other.view(np.int64), np.diff(words.first), signatures(words)))
            if not parts:
                parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, HASHES), np.uint32))]
            h1, h2, n, sig = (np.concatenate(x) for x in zip(*parts, strict=True))
            blob = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, (len(sig) + 1) * HASHES * 4, HASHES * 4, dtype=np.int32)[: len(sig) + 1]), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h1), pa.array(h2), pa.array(n), blob], names=[*batch.schema.names, "_h1", "_h2", "_n", "_sig"])

    added = [T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_sig", T.BinaryType())]
    return stage(mapped(kept, run, T.StructType([*kept.schema.fields, *added])), "described")


def blocked(members: DataFrame, group: str, node: str, size: int) -> DataFrame:
    """Members of groups, dealt to pairs of blocks: adds _b (own block) and _i <= _j (the pair), a row for each pair with its block.

    ``members`` has the group's number of rows in ``_count``; a group of up to ``size`` is a single block.
    """
    x = members.withColumn("_blocks", F.ceil(F.col("_count") / size).cast("int"))
    x = x.withColumn("_b", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return x.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_blocks", "_o", "_count").repartition(group, "_i", "_j").sortWithinPartitions(group, "_i", "_j")


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows with at least ``least`` rows if there are so many, and where each group starts."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            start = starts(table, keys)
            if len(start) > 1:
                yield table.slice(0, start[-1]), start[:-1]
                held = table.slice(start[-1]).to_batches()
                rows = table.num_rows - int(start[-1])
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table, keys)


def starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where a key differs from the row before."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs(start: np.ndarray, n: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (x, y), x < y, within groups of n rows, in portions."""
    size = np.diff(np.append(start, n))
    after = np.repeat(start + size, size) - np.arange(n) - 1  # rows after each in its group
    sums = np.concatenate([[0], np.cumsum(after)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + most, side="right")) - 1)
        x = np.repeat(np.arange(i, j), after[i:j])
        yield x, x + 1 + np.arange(len(x)) - np.repeat(sums[i:j] - sums[i], after[i:j])
        i = j


def likely(sig: np.ndarray, block: np.ndarray, band: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay. own: whether the task joins a block with itself."""
    on = own[x] | (block[x] != block[y])
    x, y = x[on], y[on]
    for b in range(BANDS):  # the first band in which a pair agrees takes it
        late = band[x] > b
        if not late.any():
            break
        same = (sig[x, b * ROWS : b * ROWS + ROWS] == sig[y, b * ROWS : b * ROWS + ROWS]).all(1)
        x, y = x[~(late & same)], y[~(late & same)]
    agree = np.zeros(len(x), np.int64)
    for c, most in enumerate(least):
        agree += (sig[x, c * CHUNK : (c + 1) * CHUNK] == sig[y, c * CHUNK : (c + 1) * CHUNK]).sum(1)
        on = agree >= most
        x, y, agree = x[on], y[on], agree[on]
    return x, y


def edges_of(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of pairs, as (node, node)."""
    if not len(x):
        return node[:0], node[:0]
    used, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = local_components(len(used), back[: len(x)], back[len(x) :])
    some = label != np.arange(len(used))
    return node[used[some]], node[used[label[some]]]


def candidate_edges(members: DataFrame, threshold: float) -> DataFrame:
    """Steps 2 to 4: a forest (u, v) of the pairs of classes that pruning leaves."""
    least = need(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in grouped(batches, ("bucket", "_i", "_j"), 20_000):
            table = table.combine_chunks()
            node, band, block = (table[c].to_numpy() for c in ("node", "band", "_b"))
            own = table["_i"].to_numpy() == table["_j"].to_numpy()
            blob = table["_sig"].combine_chunks()
            sig = utf8(blob)[0].view(np.uint32).reshape(-1, HASHES)
            kept = [likely(sig, block, band, own, x, y, least) for x, y in pairs(start, len(node))]
            if kept:
                u, v = edges_of(node, *(np.concatenate(z) for z in zip(*kept, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return mapped(members, run, "u long, v long")


def overlap_rows(sets: list[np.ndarray], dtype=np.float32, cells: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections of some sets of hashes."""
    n = len(sets)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1  # others meet nothing
    place = np.cumsum(shared) - 1
    on = shared[inverse]
    owner, column = owner[on], place[inverse[on]]
    width = int(shared.sum())
    out = np.zeros((n, n))  # parts are exact in float32, their sums in float64
    step = max(1, cells // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, width, step):
        i, j = np.searchsorted(column, [a, a + step])
        part = np.zeros((n, min(step, width - a)), dtype)
        part[owner[i:j], column[i:j] - a] = 1
        out += part @ part.T
    return out


def reached(both: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a similarity of at least ``threshold``, exactly: ``both`` and ``size`` are whole numbers.

    Division in float64 rounds correctly, so a quotient equal to the threshold as written gives that very number.
    """
    both = both.astype(np.float64)
    return both / (size[:, None] + size[None, :] - both) >= threshold


def with_sets(members: DataFrame, text: str) -> DataFrame:
    """``members`` with their shingle sets (_set: ascending hashes, as bytes) in place of the text; staged, so that blocks carry sets that are made once."""
    kept = [f for f in members.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(single(batch, text))
            sets = [x.tobytes() for i, j in steps(offsets) for x in shingle_sets(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))]
            yield pa.RecordBatch.from_arrays([*(single(batch, f.name) for f in kept), pa.array(sets, pa.binary())], names=[*(f.name for f in kept), "_set"])

    return stage(mapped(members, run, T.StructType([*kept, T.StructField("_set", T.BinaryType())])), "sets")


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """Step 5: rows (u, v, links): a forest of the exact links (links 0), and for each class the documents that a task links it with (v null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in grouped(batches, ("root", "_i", "_j"), 256):
            table = table.combine_chunks()
            node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "_b"))
            own = table["_i"].to_numpy() == table["_j"].to_numpy()
            raw, offsets = utf8(table["_set"].combine_chunks())
            size = np.diff(offsets) // 8
            u, v, links = [], [], []
            for a, b in zip(start, [*start[1:], len(node)], strict=True):
                sets = [np.frombuffer(raw[offsets[k] : offsets[k + 1]].tobytes(), np.uint64) for k in range(a, b)]
                linked = reached(overlap_rows(sets), size[a:b], threshold)
                np.fill_diagonal(linked, False)
                if not own[a]:
                    linked &= block[a:b, None] != block[None, a:b]
                n = linked @ copies[a:b]
                x, y = np.nonzero(np.triu(linked))
                p, q = edges_of(node[a:b], x, y)
                some = n > 0
                u += [p, node[a:b][some]]
                v += [q, np.full(int(some.sum()), -1)]
                links += [np.zeros(len(p), np.int64), n[some]]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).astype(np.int64)) for z in (u, v, links)], names=["u", "v", "links"])

    return mapped(members, run, "u long, v long, links long")


def similarity_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs`` with _links (other documents whose similarity is at least ``threshold``), _component (the least key that links reach, null if it has none), _kept (one row of each component).

    Texts with the same words are linked. A null text, or one without words, is linked with nothing and kept. Repeated rows
    are linked copies; keys may be repeated or null (the least non-null key names a component; the row kept is the first by key,
    non-null first). Other columns pass through; those named like the ones added are replaced. An empty table gives an empty one.
    """
    sealed = Sealed(docs, "_links", "_component", "_kept")
    key, text = sealed[key], sealed[text]
    table = describe(sealed.df, text)
    slim = table.select("_rid", F.col(key).alias("_key"), "_h1", "_h2", "_n")
    classes = stage(slim.where("_n > 0").groupBy("_h1", "_h2").agg(F.min("_rid").alias("node"), F.count("*").alias("copies")), "classes")

    # Bands of the classes' signatures, and the buckets with several classes.
    represent = table.select(F.col("_rid").alias("node"), "_sig").join(classes.select("node"), "node")
    band = lambda k: F.xxhash64(F.lit(k), F.substring("_sig", k * ROWS * 4 + 1, ROWS * 4))
    postings = represent.select("node", F.posexplode(F.array(*(band(k) for k in range(BANDS)))).alias("band", "bucket"))
    postings = stage(postings, "postings")
    full = postings.groupBy("bucket").agg(F.count("*").alias("_count")).where("_count > 1")
    active = stage(postings.join(full, "bucket"), "active")
    members = blocked(active.join(represent, "node"), "bucket", "node", block)
    groups = components(candidate_edges(members, threshold))

    # Exact links within groups.
    counted = groups.join(broadcast_if_small(stage(groups.groupBy("root").agg(F.count("*").alias("_count")), "groups")), "root")
    whole = table.select(F.col("_rid").alias("node"), F.col(text).alias("_text"))
    part = counted.join(classes.select("node", "copies"), "node")
    sets = with_sets(whole.join(broadcast_if_small(stage(part, "group-members")), "node"), "_text")
    exact = stage(verified(blocked(sets, "root", "node", block), threshold), "links")
    discard(sets, postings, active)
    roots = components(exact.where("v >= 0").select("u", "v"))
    links = exact.where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))

    # Back to rows: classes carry their component and links.
    of_class = classes.join(roots, "node", "left").join(links, "node", "left")
    of_class = stage(of_class.select("_h1", "_h2", F.coalesce("root", "node").alias("_root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links")), "class-links")
    some = of_class.where("_links > 0")
    rows = slim.where("_n > 0").join(broadcast_if_small(some), ["_h1", "_h2"])
    rows = stage(rows.select("_rid", "_key", "_root", "_links"), "linked-rows")
    least = rows.groupBy("_root").agg(F.min(F.struct(F.col("_key").isNull().alias("null"), F.col("_key").alias("key"), F.col("_rid").alias("rid"))).alias("_first"))
    named = broadcast_if_small(stage(least, "components"))
    linked = rows.join(named, "_root").select("_rid", F.col("_links").alias("_l"), F.col("_first")["key"].alias("_component"), (F.col("_first")["rid"] == F.col("_rid")).alias("_k"), F.lit(True).alias("_in"))
    out = table.drop("_h1", "_h2", "_n", "_sig").join(broadcast_if_small(stage(linked, "links-of-rows")), "_rid", "left")
    return sealed.open(
        out,
        _links=F.coalesce("_l", F.lit(0)).cast("long"),
        _component=F.when(F.col("_in"), F.col("_component")).otherwise(F.col(key)),
        _kept=F.coalesce("_k", F.lit(True)),
    )
