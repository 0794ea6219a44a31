"""Sharding by bytes with a minimax contiguous partition of groups; DataFrame and SQL functions only.

Groups (equal texts) are atomic and stand in the order of their hash. The smallest capacity under which a greedy pass
over the groups needs no more than the given number of shards is found by binary search; then the sequence is cut, each
shard as near to its share of what is left as that capacity allows.

The search works on atoms: a group that crosses a border of 1/512 of a shard's bytes is an atom of its own, the groups between
two borders are one atom together. So there are at most some 1,000 atoms a shard, however many groups there are, no atom but a single group has
more than 1/512 of a shard, and where all groups are larger than that, atoms are groups. Groups of more than half a shard
(fewer than twice the number of shards) are put a shard's share apart, so that small ones fill the rest of their shards.

Prefix sums are made in two levels (buckets of some thousand groups or rows, then within a bucket), cuts are keys in the order of hashes, so rows
find their shard without a join, and a group with a third of all rows isn't gathered anywhere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Sealed, broadcast_if_small, stage

SHARDS = 24
#: Bytes that a row has beside its text.
ROW_BYTES = 8
ATOMS_A_SHARD, BUCKET_ROWS, SALTS = 512, 4096, 64


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and of what a row has besides."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + ROW_BYTES).cast("long")


def text_group(text: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits that tell texts apart; null is the empty text."""
    body = F.coalesce(text, F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit(7), body)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def partition(ends: Column, total: int, least: int, shards: int) -> Column:
    """struct(capacity, cuts) for cumulative sizes ``ends`` (0 first): the smallest capacity under which the atoms fill at most ``shards`` shards, and the end of each shard.

    Sizes after an index are looked up by descent over powers of two, so a greedy check takes shards × log(atoms) steps.
    """
    n = F.size(ends).cast("long") - 1
    at = lambda i: F.element_at(ends, (i + 1).cast("int"))
    bits = F.array(*(F.lit(1 << b).cast("long") for b in reversed(range(24))))
    long = lambda x: F.lit(x).cast("long")
    upto = lambda s, most: F.aggregate(bits, s, lambda i, b: F.when((i + b <= n) & (F.try_element_at(ends, (i + b + 1).cast("int")) <= at(s) + most), i + b).otherwise(i))
    downto = lambda e, most: F.aggregate(bits, e, lambda i, b: F.when((i >= b) & (at(e) - F.try_element_at(ends, (F.greatest(i - b, long(0)) + 1).cast("int")) <= most), i - b).otherwise(i))
    fits = lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(shards)), long(0), lambda s, _: upto(s, c)) == n

    def halve(z: Column, _: Column) -> Column:
        mid = F.floor((z["low"] + z["high"]) / 2).cast("long")
        step = lambda m: F.when(z["low"] >= z["high"], z).when(fits(m), F.struct(z["low"].alias("low"), m.alias("high"))).otherwise(F.struct((m + 1).alias("low"), z["high"].alias("high")))
        return bound(mid, step)

    start = F.struct(long(max(least, -(-total // shards))).alias("low"), long(max(total, least)).alias("high"))
    rounds = max(1, math.ceil(math.log2(max(2, total + 1))) + 1)
    capacity = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda z: z["high"])

    def cut(c: Column) -> Column:
        # the least index from which the rest fits in 0, 1, .. shards
        needs = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.array(n), lambda z, _: F.concat(z, F.array(downto(F.element_at(z, -1), c))))

        def take(need: Column) -> Column:
            def one(z: Column, k: Column) -> Column:
                s = z["s"]
                left = (F.lit(shards) - k).cast("int")
                share = (at(n) - at(s)) / left

                def nearest(i: Column) -> Column:
                    closer = at(F.least(i + 1, n)) - at(s) - share < share - (at(i) - at(s))
                    wanted = F.greatest(F.when(closer, F.least(i + 1, n)).otherwise(i), F.least(s + 1, n))
                    end = F.greatest(F.least(wanted, upto(s, c)), F.element_at(need, left))
                    return bound(end, lambda e: F.struct(e.alias("s"), F.concat(z["cuts"], F.array(e)).alias("cuts")))

                return bound(upto(s, F.floor(share).cast("long")), nearest)

            zero = F.struct(long(0).alias("s"), F.array().cast("array<bigint>").alias("cuts"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), zero, one, lambda z: z["cuts"])

        return F.struct(c.alias("capacity"), bound(needs, take).alias("cuts"))

    return bound(capacity, cut)


def spread(large: list[int], total: int, shards: int) -> list[int]:
    """How many bytes of small groups stand before each large group (sizes in descending order): what fills the shards of those before it."""
    rest, left = total, shards
    for size in large:  # those larger than an equal share have a shard alone
        if left < 2 or size * left < rest:
            break
        rest, left = rest - size, left - 1
    level, before, out = rest // left, 0, []
    for size in large:
        out.append(before)
        before += max(0, level - size)
    return out


def shard(docs: DataFrame, *, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id",), text: str = "text", size: Column | None = None, group: tuple[Column, Column] | None = None) -> DataFrame:
    """All rows with _size, _shard (0 .. shards - 1), _slot (gapless from 0 within a shard, in an order by hash) and _capacity (the smallest feasible one, of all atoms).

    Rows of equal groups (two longs; by default the hashes of the text, null as the empty text) share a shard. With fewer groups than shards, some shards
    stay empty; an empty table gives no rows. Equal rows each have a slot of their own and are interchangeable. Columns of the names given here are replaced.
    ``size`` (bytes, by default those of the text and 8) and ``group`` are expressions over ``docs``.
    """
    own = ("_size", "_shard", "_slot", "_capacity")
    size = text_size(F.col(text)) if size is None else size
    group = text_group(F.col(text)) if group is None else group
    sealed = Sealed(docs.select(size.cast("long").alias("-"), group[0].alias("-"), group[1].alias("-"), "*"), *own)
    made, sealed.inner, sealed.names = sealed.inner[:3], sealed.inner[3:], sealed.names[3:]
    keys = [F.col(sealed[c]) for c in key]
    # the salt is stored, so that equal rows are dealt to several buckets and every later pass sees the same deal
    rows = stage(sealed.df.select(*sealed.inner, *(F.col(m).alias(c) for m, c in zip(made, ("_size", "_g", "_h"), strict=True)), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")), "rows")
    groups = stage(rows.groupBy("_g", "_h").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_groups, n_rows = (x or 0 for x in groups.agg(F.sum("bytes"), F.count("*"), F.sum("n")).first())

    # Large groups, fewer than 2 * shards.
    is_large = F.col("bytes") * (2 * shards) > F.lit(total)
    large = groups.where(is_large).orderBy(F.desc("bytes"), "_g", "_h").limit(2 * shards).collect()
    places = spread([r["bytes"] for r in large], total, shards)
    lits = lambda values: F.array(*(F.lit(v).cast("long") for v in values)) if values else F.array().cast("array<bigint>")

    # Where each small group starts among them.
    n_buckets = max(1, -(-n_groups // BUCKET_ROWS))
    bucket = F.least(F.floor((F.col("_g") / F.lit(2.0**64) + 0.5) * n_buckets), F.lit(n_buckets - 1))
    small = groups.where(~is_large).withColumn("bucket", bucket)
    before = F.sum("bytes").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(small.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).select("bucket", F.coalesce(before, F.lit(0)).alias("off")), "offsets")
    within = F.coalesce(F.sum("bytes").over(Window.partitionBy("bucket").orderBy("_g", "_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = small.withColumn("in", within).join(broadcast_if_small(offsets), "bucket").withColumn("pos", F.col("off") + F.col("in"))

    # Atoms, in order.
    width = max(1, -(-total // (shards * ATOMS_A_SHARD)))
    border = lambda c: F.floor(c / F.lit(width)).cast("long")
    passed = F.size(F.filter(lits(places), lambda p: p <= F.col("pos")))
    small = small.groupBy(passed.alias("c"), border(F.col("pos")).alias("i"), border(F.col("pos") + F.col("bytes") - 1).alias("j")).agg(F.min("pos").alias("pos"), F.min(F.struct("_g", "_h")).alias("first"), F.sum("bytes").alias("bytes"))
    atoms = small.select("pos", F.lit(1).alias("kind"), F.lit(0).alias("nth"), "first._g", "first._h", "bytes")
    schema = "pos long, kind int, nth int, _g long, _h long, bytes long"
    atoms = atoms.unionByName(docs.sparkSession.createDataFrame([(p, 0, n, r["_g"], r["_h"], r["bytes"]) for n, (p, r) in enumerate(zip(places, large, strict=True))], schema))
    order = Window.orderBy("pos", "kind", "nth", "_g", "_h")
    atoms = stage(atoms.withColumns({"at": F.row_number().over(order) - 1, "end": F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))}), "atoms")

    # The partition, and what rows need to know of it: a key for each cut, a shard for each large group.
    ends = F.concat(lits([0]), F.transform(F.array_sort(F.collect_list(F.struct("at", "end"))), lambda x: x["end"]))
    least = atoms.agg(F.max("bytes")).first()[0] or 0
    found = stage(atoms.agg(ends.alias("ends")), "ends").select(partition(F.col("ends"), total, least, shards).alias("p")).first()["p"]
    of_atom = F.size(F.filter(lits(found["cuts"]), lambda c: c <= F.col("at")))
    dealt = atoms.withColumn("shard", of_atom)
    firsts = dealt.where("kind = 1").groupBy("shard").agg(F.min(F.struct("_g", "_h")).alias("k")).orderBy("shard").collect()
    large_shards = dealt.where("kind = 0").select("_g", "_h", "shard").collect()
    same = lambda r: (F.col("_g") == F.lit(r["_g"])) & (F.col("_h") == F.lit(r["_h"]))
    from_ = lambda k: (F.col("_g") > F.lit(k["_g"])) | ((F.col("_g") == F.lit(k["_g"])) & (F.col("_h") >= F.lit(k["_h"])))
    choice = reduce(lambda c, r: c.when(same(r), F.lit(r["shard"])), large_shards, F.when(F.lit(False), F.lit(0)))
    choice = reduce(lambda c, r: c.when(from_(r["k"]), F.lit(r["shard"])), reversed(firsts), choice)
    rows = rows.withColumn("_shard", choice.otherwise(F.lit(0)).cast("int"))

    # Slots: buckets of some thousand rows of a shard, then rows within a bucket.
    mixed = F.xxhash64(F.lit(11), *keys, "_g", "_h")
    rows = rows.withColumns({"_mixed": mixed, "_part": F.pmod(F.xxhash64("_mixed", "_salt"), F.lit(max(1, n_rows // (shards * BUCKET_ROWS))))})
    upto = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_shard", "_part").agg(F.count("*").alias("n"))
    starts = stage(starts.select(F.col("_shard").alias("s"), F.col("_part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("off")), "slots")
    nth = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_mixed", *keys, "_salt"))
    rows = rows.withColumn("_nth", nth).join(broadcast_if_small(starts), (F.col("_shard") == F.col("s")) & (F.col("_part") == F.col("p")))
    return sealed.open(rows, _size=F.col("_size"), _shard=F.col("_shard"), _slot=(F.col("off") + F.col("_nth") - 1).cast("long"), _capacity=F.lit(found["capacity"]).cast("long"))
