"""Near-duplicate vectors by an epsilon grid order join.

Vectors of one label, scaled to length 1, have a cosine of at least t if their distance is at most eps = sqrt(2 - 2t). They are
projected on a few orthonormal principal directions, which never lengthens a distance; the grid has cells of width eps there.
In the order of (label, cells) the sequence is cut into blocks, each with the box of its projections. Blocks are paired
if they have cells next to each other in the first three directions and their boxes are within eps; a task joins two blocks,
halving both sequences again and again and skipping intervals whose boxes are apart, and compares what is left exactly, in
double precision. Directions are fitted on a bounded sample; they decide only what is skipped, never what links.

Equal vectors are one class with a count. A task gives counts of links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sealed, broadcast_if_small, mapped, single, stage
from .components import components
from .ngrams import edges_of

THRESHOLD = 0.98
DIRECTIONS, SAMPLE_ROWS, SAMPLE_BYTES = 6, 4096, 16 << 20
BLOCK, LEAF = 1024, 128
#: Directions in whose cells blocks must be next to each other to be paired.
MEETING = 3
INFO = "id long, g long, n long, low array<double>, high array<double>"


def _vectors(rows: DataFrame) -> DataFrame:
    """_rid, _key, _label, g (of label and length), h1, h2 (of the components), data (doubles); g null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, h1, h2, size = [], [], [], []
            for label, v in zip(single(batch, "_label").to_pylist(), single(batch, "_v"), strict=True):
                x = None
                if label is not None and v.is_valid and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(float) + 0.0
                    if not len(x) or not np.isfinite(x).all() or not x.any():
                        x = None
                blob = None if x is None else x.tobytes()
                digest = hashlib.blake2b(blob or b"", digest_size=16).digest()
                data.append(blob)
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                size.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [single(batch, "_rid"), single(batch, "_label"), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(data, pa.binary())],
                names=["_rid", "_label", "size", "h1", "h2", "data"],
            )

    out = mapped(rows, run, "_rid long, _label string, size long, h1 long, h2 long, data binary")
    return stage(out.withColumn("g", F.when(F.col("data").isNotNull(), F.xxhash64("_label", "size"))).drop("_label"), "vectors")


def directions(sample: list[bytes], k: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, up to k orthonormal directions in which it varies most."""
    out = {}
    for size in {len(b) // 8 for b in sample}:
        x = np.array([np.frombuffer(b) for b in sample if len(b) == size * 8])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(0)
        _, v = np.linalg.eigh(x.T @ x)
        out[size] = np.ascontiguousarray(v[:, ::-1][:, :k])
    return out


def unit(blobs: list[bytes]) -> np.ndarray:
    """Rows of length 1."""
    x = np.frombuffer(b"".join(blobs)).reshape(len(blobs), -1)
    scale = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def projected(x: np.ndarray, basis: dict[int, np.ndarray], k: int = DIRECTIONS) -> np.ndarray:
    """Projections, filled up with zeros."""
    out = np.zeros((len(x), k))
    if (b := basis.get(x.shape[1])) is not None:
        out[:, : b.shape[1]] = x @ b
    return out


def links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of all pairs with a cosine of at least ``threshold``, by halving both sequences."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        low = np.maximum(pa_[i:j].min(0), pb[k:m].min(0)) - np.minimum(pa_[i:j].max(0), pb[k:m].max(0))
        if (np.maximum(low, 0) ** 2).sum() > eps * eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[i:j] @ b[k:m].T >= threshold)
            found.append((x + i, y + k))
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``rows`` with _links (other rows linked directly) and _component (the least key that links reach, itself included).

    Rows are linked if their labels are equal and not null, their vectors have one length, and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing. Equal
    rows are linked copies. Keys may be repeated; null keys name no component. Other columns pass through; an empty table gives an empty one.
    """
    sealed = Sealed(rows, "_links", "_component")
    key, vector, label = sealed[key], sealed[vector], sealed[label]
    rows = stage(sealed.df.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    vectors = _vectors(rows.select("_rid", F.col(label).cast("string").alias("_label"), F.col(vector).alias("_v")))
    valid = vectors.where("g is not null")
    classes = stage(valid.groupBy("g", "h1", "h2").agg(F.min("_rid").alias("node"), F.count("*").alias("copies")), "classes")
    facts = valid.agg(F.count("*").alias("n"), F.max("size").alias("size")).first()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (facts["size"] or 1))))
    sample = valid.where(F.pmod("h1", F.lit(max(1, -(-facts["n"] // most)))) == 0).select("data").limit(2 * most).collect()
    basis = rows.sparkSession.sparkContext.broadcast(directions([bytes(r["data"]) for r in sample]))
    cells = [f"c{i}" for i in range(DIRECTIONS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = single(batch, "data").to_pylist()
            grid = np.zeros((len(blobs), DIRECTIONS), np.int64)
            for size in {len(b) for b in blobs}:
                some = [i for i, b in enumerate(blobs) if len(b) == size]
                grid[some] = np.floor(projected(unit([blobs[i] for i in some]), basis.value) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, i]) for i in range(DIRECTIONS))], names=[*batch.schema.names, *cells])

    one = valid.select(F.col("_rid").alias("node"), "data").join(classes.select("node", "g", "copies"), "node").select("node", "g", "copies", "data")
    grid = stage(mapped(one, place, "node long, g long, copies long, data binary, " + ", ".join(f"{c} long" for c in cells)), "grid")
    ordered = grid.repartitionByRange("g", *cells, "node").sortWithinPartitions("g", *cells, "node").select("g", "node", "copies", "data")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held = TaskContext.get().partitionId(), 0, ([], [], [])
        group = None

        def out() -> pa.RecordBatch:
            p = projected(unit(held[2]), basis.value)
            row = {"id": (task << 32) + nth, "g": group, "n": len(held[0]), "low": p.min(0).tolist(), "high": p.max(0).tolist(), "nodes": np.array(held[0]).tobytes(), "copies": np.array(held[1]).tobytes(), "data": b"".join(held[2])}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for g, *row in zip(*(single(batch, c).to_pylist() for c in ("g", "node", "copies", "data")), strict=True):
                if held[0] and (g != group or len(held[0]) >= block):
                    yield out()
                    nth, held = nth + 1, ([], [], [])
                group = g
                for x, y in zip(held, row, strict=True):
                    x.append(y)
        if held[0]:
            yield out()

    blocks = stage(mapped(ordered, cut, INFO + ", nodes binary, copies binary, data binary"), "blocks")
    info = blocks.select("id", "g", "low", "high")
    met_in = [f"m{i}" for i in range(MEETING)]

    def in_cells(x: DataFrame, margin: int) -> DataFrame:
        """A row for each cell of the first directions that a block's box is in, or next to."""
        cell = lambda c, i: F.floor(F.col(c)[i] / eps)
        for i, name in enumerate(met_in):
            x = x.withColumn(name, F.explode(F.sequence(cell("low", i) - margin, cell("high", i) + margin)))
        return x

    left = in_cells(info, 0).select(F.col("id").alias("a"), "g", F.col("low").alias("al"), F.col("high").alias("ah"), *met_in)
    right = in_cells(info, 1).select(F.col("id").alias("b"), "g", F.col("low").alias("bl"), F.col("high").alias("bh"), *met_in)
    apart = F.aggregate(
        F.arrays_zip("al", "ah", "bl", "bh"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x["al"] - x["bh"], x["bl"] - x["ah"], F.lit(0.0)), F.lit(2.0))
    )
    met = left.join(right, ["g", *met_in]).where((F.col("a") <= F.col("b")) & (apart <= eps * eps)).select("a", "b").distinct()
    sides = stage(met.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")), "pairs")
    work = blocks.select("id", "nodes", "copies", "data").join(broadcast_if_small(sides), "id")

    def compare(table: pa.Table) -> pa.Table:
        one, two = table["a"][0].as_py(), table["b"][0].as_py()
        part = {}
        for r in table.select(["id", "nodes", "copies", "data"]).to_pylist():
            nodes = np.frombuffer(r["nodes"], np.int64)
            x = np.frombuffer(r["data"]).reshape(len(nodes), -1)
            part[r["id"]] = (nodes, np.frombuffer(r["copies"], np.int64), unit([v.tobytes() for v in x]))
        (n1, c1, u1), (n2, c2, u2) = part[one], part[two]
        x, y = links(u1, u2, projected(u1, basis.value), projected(u2, basis.value), threshold, eps)
        if one == two:
            x, y = x[x < y], y[x < y]
            nodes, copies = n1, c1
        else:
            nodes, copies, y = np.concatenate([n1, n2]), np.concatenate([c1, c2]), y + len(n1)
        count = np.bincount(x, copies[y], len(nodes)) + np.bincount(y, copies[x], len(nodes))
        p, q = edges_of(nodes, x, y)
        some = count > 0
        u, v, n = np.concatenate([p, nodes[some]]), np.concatenate([q, np.full(int(some.sum()), -1)]), np.concatenate([np.zeros(len(p)), count[some]])
        return pa.table({"u": pa.array(u.astype(np.int64)), "v": pa.array(v.astype(np.int64)), "links": pa.array(n.astype(np.int64))})

    exact = stage(work.groupBy("a", "b").applyInArrow(compare, "u long, v long, links long"), "links")
    roots = components(exact.where("v >= 0").select("u", "v"))
    counts = exact.where("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    of_class = classes.join(roots, "node", "left").join(counts, "node", "left")
    of_class = of_class.select("g", "h1", "h2", F.coalesce("root", "node").alias("_root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    of_class = stage(of_class.where("_links > 0"), "class-links")
    linked = valid.select("_rid", "g", "h1", "h2").join(broadcast_if_small(of_class), ["g", "h1", "h2"]).select("_rid", "_root", "_links")
    linked = stage(linked.join(rows.select("_rid", F.col(key).alias("_key")), "_rid"), "linked")
    named = stage(linked.groupBy("_root").agg(F.min("_key").alias("_least")), "components")
    linked = linked.drop("_key").join(broadcast_if_small(named), "_root").drop("_root")
    out = rows.join(linked, "_rid", "left")
    return sealed.open(out, _links=F.coalesce("_links", F.lit(0)).cast("long"), _component=F.when(F.col("_links").isNotNull(), F.col("_least")).otherwise(F.col(key)))
