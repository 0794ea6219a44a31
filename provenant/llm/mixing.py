"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame and SQL functions only.

Every source is a line of words: its documents in an order fixed by a hash, end to end, and repeated if the
source's target is more than it has. The line is cut into blocks of ``block_words`` words, and the source's
quota is the blocks up to its target. A binary tree then deals the blocks of all sources to the output shards:
each node splits its vector of block counts by an exact multivariate-hypergeometric draw (source after source,
each by inversion of the hypergeometric distribution), so every shard is a uniform draw without replacement
from the whole mix, and the sources' sums stay exact. A source's blocks are permuted by a hash, and a shard draws
the next ones of them, as many as the tree gave it; so draws are disjoint. What the mix takes are the words of drawn
blocks: a document's copy goes with the block in which it starts. A shard shuffles only its own rows.

The order along a line is a prefix sum that is computed in two levels (buckets of some thousand documents,
then rows within a bucket), so a source with a third of all rows is not one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Sealed, broadcast_if_small, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Least words of a block and of a shard; both grow with the corpus so that it has at most MOST_BLOCKS.
BLOCK_WORDS, SHARD_BLOCKS, MOST_BLOCKS = 4096, 256, 1 << 20
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """A row for each source: sid, source, source_size, n_rows, target, quota (words, an integer).

    Targets are weights times a level, cut at ``most`` times the source's size, at the level where they share
    all sizes: what resharing the excess by weight comes to. With the sources in ascending order of the level at
    which they are cut, the level is the first at which those cut before and the others' weights add up.
    Windows here run over a row for each source only.
    """
    sources = stage(sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
    n = len(weights)
    by_code_point = Window.orderBy(F.asc_nulls_last(F.encode("_source", "utf-8")))
    x = sources.withColumn("sid", F.row_number().over(by_code_point) - 1)
    x = x.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") % n + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    x = x.withColumns({
        "cut": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)),
        "all": F.sum("source_size").over(every).cast("double"),
    })
    level = (F.col("all") - F.col("cut")) / F.col("left")
    x = x.withColumn("rank", F.row_number().over(order))
    x = x.withColumn("level", F.min(F.when(level <= F.col("cap") / F.col("w"), F.struct("rank", level.alias("level")))).over(every)["level"])
    x = x.withColumn("target", F.least("cap", F.col("w") * F.coalesce("level", F.lit(0.0))))
    x = x.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most))
    return stage(x.select(F.col("sid").cast("int").alias("sid"), "_source", "source_size", "n_rows", "target", "quota"), "targets")


def ln_factorial(n: str) -> str:
    """SQL for ln(n!) by Stirling's series; exact to 1e-5 at 2 and better beyond."""
    return f"(case when {n} < 2 then 0D else ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1D / (12D * {n}) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5)) end)"


def hypergeometric(good: str, total: str, drawn: str, u: str) -> str:
    """SQL for a draw by inversion: how many of ``drawn`` out of ``total`` are among ``good``; u is uniform in [0, 1)."""
    choose = lambda n, k: f"({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')})"
    p = f"exp({choose(good, 'x')} + {choose(f'({total} - {good})', f'({drawn} - x)')} - {choose(total, drawn)})"
    low, high = f"greatest(0L, {drawn} - ({total} - {good}))", f"least({good}, {drawn})"
    return (
        f"aggregate(sequence({low}, {high}), struct(0D as c, -1L as x), "
        f"(a, x) -> if(a.x >= 0, a, struct(a.c + {p} as c, if(a.c + {p} > {u}, x, -1L) as x)), a -> if(a.x < 0, {high}, a.x))"
    )


def splitting_tree(counts: DataFrame, levels: int, seed: int) -> DataFrame:
    """Deal blocks to 2**levels shards: (shard, sid, k) for the (sid, k) of ``counts``, k blocks of each source.

    One row for each node and level; a node's array has an entry for each source.
    """
    nodes = counts.agg(F.array_sort(F.collect_list(F.struct(F.col("sid"), F.col("k").cast("long").alias("k")))).alias("have")).withColumn("node", F.lit(1).cast("long"))
    u = f"(shiftrightunsigned(xxhash64({seed}L, node, s.sid), 11) / 9007199254740992D)"
    for level in range(levels):
        if level and level % 6 == 0:
            nodes = nodes.repartition("node")
        nodes = nodes.withColumn("total", F.expr("aggregate(have, 0L, (n, s) -> n + s.k)"))
        draw = hypergeometric("s.k", "z.total", "z.drawn", u)
        nodes = nodes.withColumn(
            "left",
            F.expr(
                "aggregate(have, struct(total as total, (total + 1) div 2 as drawn, cast(array() as array<bigint>) as got), "
                f"(z, s) -> transform(array({draw}), d -> struct(z.total - s.k as total, z.drawn - d as drawn, concat(z.got, array(d)) as got))[0], z -> z.got)"
            ),
        )
        both = F.expr(
            "array(struct(2 * node as node, zip_with(have, left, (s, d) -> struct(s.sid as sid, d as k)) as have), "
            "struct(2 * node + 1 as node, zip_with(have, left, (s, d) -> struct(s.sid as sid, s.k - d as k)) as have))"
        )
        nodes = nodes.select(F.explode(both).alias("n")).select("n.node", "n.have")
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.explode("have").alias("s")).select("shard", "s.sid", "s.k").where("k > 0")


def draws(sources: DataFrame, block: int, levels: int, seed: int) -> DataFrame:
    """The blocks that each shard draws: (sid, block, shard), staged. Sources' blocks are permuted, and shards take the next ones in turn."""
    blocks = sources.where("quota > 0").select("sid", F.explode(F.expr(f"sequence(0L, (quota - 1L) div {block}L)")).alias("block"))
    nth = F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed + 2), "sid", "block"), "block"))
    leaves = splitting_tree(sources.select("sid", F.expr(f"(quota + {block - 1}L) div {block}L").alias("k")).where("k > 0"), levels, seed)
    upto = F.sum("k").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    taken = leaves.withColumn("last", upto).select("sid", "shard", F.explode(F.expr("sequence(last - k + 1, last)")).alias("nth"))
    return stage(blocks.withColumn("nth", nth.cast("long")).join(taken, ["sid", "nth"]).select("sid", "block", "shard"), "draws")


def mix(docs: DataFrame, *, key: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 7, keep_undrawn: bool = False, parts: bool = False, block_words: int | None = None) -> DataFrame:
    """A row for each copy of a document that the mix takes: its columns, and _size, _source_size, _target, _copy (0, 1, ..), _taken (words), _shard, _order.

    Sources in order of code point, null last, have ``weights`` in turn. Each source's words come to its target,
    rounded: one document of a source may be taken in part (_taken < _size), all others whole. A document comes at
    most ``most`` times. Texts that are null or without words have size 0 and are never drawn; with
    ``keep_undrawn``, documents that are not drawn come once with null _copy and _taken 0. With ``parts`` there is a row for each block that
    a copy has words in, with the words that it has there, instead of one in the block where it starts. Equal rows are interchangeable,
    so reruns agree. No rows, or none with words: none are drawn. Columns of the names given here are replaced. ``size`` is an expression over ``docs``.
    """
    own = ["_size", "_source_size", "_target", "_copy", "_taken", "_shard", "_order"]
    size = word_count(F.col(text)) if size is None else size
    sealed = Sealed(docs.select(size.alias("-"), "*"), *own)
    words_of = sealed.inner.pop(0)
    sealed.names.pop(0)
    keys = [F.col(sealed[c]) for c in key]
    has_text = any(c.lower() == text.lower() for c in sealed.names)
    hashed = F.xxhash64(F.lit(seed), *keys)
    sized = sealed.df.select(*sealed.inner, F.col(words_of).alias("_size"), F.col(sealed[source]).cast("string").alias("_source"), hashed.alias("_h"))
    slim = stage(sized.select("_source", "_size", "_h"), "sizes")
    sources = source_targets(slim.select("_source", "_size"), weights, most)
    total = sources.agg(F.sum("quota")).first()[0] or 0
    block = block_words or max(BLOCK_WORDS, -(-total // MOST_BLOCKS))
    levels = max(0, math.ceil(math.log2(max(1, total / (block * SHARD_BLOCKS)))))

    # Where each document starts on its source's line.
    facts = sources.select(F.col("_source").alias("_named"), "sid", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "quota", (F.col("n_rows") / BUCKET_ROWS).cast("long").alias("_wide"))
    placed = lambda x: x.join(broadcast_if_small(facts), x["_source"].eqNullSafe(facts["_named"]), "left").drop("_source", "_named").withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.col("_wide") + 1))
    buckets = placed(slim).groupBy("sid", "_bucket").agg(F.sum("_size").alias("n"))
    before = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(buckets.select(F.col("sid").alias("_sid"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off")), "offsets")
    rows = placed(sized)
    within = Window.partitionBy("sid", "_bucket").orderBy("_h", *keys, F.xxhash64(*([F.col(sealed[text])] if has_text else [F.lit(0)])))
    rows = rows.withColumn("_in", F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(broadcast_if_small(offsets), (rows["sid"] == offsets["_sid"]) & (rows["_bucket"] == offsets["_b"]), "left").withColumn("_at", F.col("_off") + F.col("_in"))

    # The blocks that each copy has words in, or the one that it starts in.
    starts = f"filter(transform(sequence(0, {most - 1}), e -> struct(e as copy, e * _source_size + _at as low, least((e * _source_size + _at) + _size, quota) as high)), c -> c.high > c.low)"
    words = f"struct(c.copy as copy, b as block, least(c.high, (b + 1) * {block}L) - greatest(c.low, b * {block}L) as words)"
    split = f"flatten(transform({starts}, c -> transform(sequence(c.low div {block}L, (c.high - 1) div {block}L), b -> {words})))"
    whole = f"transform({starts}, c -> struct(c.copy as copy, c.low div {block}L as block, c.high - c.low as words))"
    rows = rows.withColumn("_c", (F.explode_outer if keep_undrawn else F.explode)(F.expr(split if parts else whole)))

    # What the shards draw of them.
    dealt = draws(sources, block, levels, seed).select(F.col("sid").alias("_sid"), F.col("block").alias("_block"), F.col("shard").alias("_shard"))
    rows = rows.drop("_sid", "_b").join(broadcast_if_small(dealt), (F.col("sid") == F.col("_sid")) & (F.col("_c.block") == F.col("_block")), "left")
    rows = rows.where(F.col("_shard").isNotNull() | F.lit(keep_undrawn))
    drawn = F.col("_shard").isNotNull()
    return sealed.open(
        rows,
        _size=F.col("_size"),
        _source_size=F.col("_source_size"),
        _target=F.col("_target"),
        _copy=F.when(drawn, F.col("_c.copy")),
        _taken=F.when(drawn, F.col("_c.words")).otherwise(F.lit(0)).cast("long"),
        _shard=F.col("_shard"),
        _order=F.when(drawn, F.xxhash64(F.lit(seed + 1), "_h", "_c.copy")),
    )


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix as its shards hold it: a partition holds whole shards, each in its own random order."""
    return mixed.repartition("_shard").sortWithinPartitions("_shard", "_order")
