"""The registered queries of the operators here, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate as wm
from . import conversations, langid, licenses, mixing, ngrams, periodic, quality, repeats, secrets, sharding, tokens, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix takes: those of the blocks that shards draw; its copies, their shards, and the place of the first in its shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"))
    mixed = mixing.mix(docs, key=("doc_id", "t"), size=F.col("size"), keep_undrawn=True, parts=True)
    place = F.row_number().over(Window.partitionBy("_shard", F.when(F.col("_shard").isNull(), F.col("row") % 1024)).orderBy("_order", "row"))
    first = F.min(F.when(F.col("_copy").isNotNull(), F.struct("_copy", "_shard", "_place")))
    by_row = mixed.withColumn("_place", place).groupBy("row", "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"))
    out = by_row.agg(F.sum("_taken").alias("taken"), F.count_distinct("_copy").alias("copies"), F.array_join(F.array_sort(F.collect_set("_shard")).cast("array<string>"), ",").alias("shards"), first.alias("_first"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", F.col("_first._place").alias("place"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from positives and unlabelled text outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs, model).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the record files, and their checksum."""
    import public_tokenizers

    out = tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("key", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: counts and places."""
    docs = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return docs.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("_spans")).alias("spans"))


OP4 = ",\n".join(
    f"""c{i} AS (SELECT rid, i, '{r.kind}' AS kind, {i} AS rank,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS a, length(h[i]) AS n, length(k[i]) AS least
  FROM (SELECT rid, g, h, k, unnest(range(1, len(h) + 1)) AS i FROM (SELECT rid, string_split_regex(t, $re${r.regex}$re$) AS g, regexp_extract_all(t, $re${r.regex}$re$) AS h,
    regexp_extract_all(t, $re${r.regex}$re$, {r.group}) AS k FROM d)) WHERE length(k[i]) >= {r.least})"""
    for i, r in enumerate(secrets.RULES)
)
OP4 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {OP4},
s AS ({" UNION ALL ".join(f"SELECT rid, kind, rank, a, a + n AS b FROM c{i}" for i in range(len(secrets.RULES)))}),
f AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (rid)"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn_dictionaries(docs, ~held_out())
    found = langid.predict(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of each vector."""
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("_component"), F.lit(False)).alias("kept"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document, and the digest of what remains.

    Beyond that, whether a document holds a passage of over 50 words that another document holds too, be it shorter than the
    strings that are removed; ``removed`` lists the removed byte ranges.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    holders = repeats.passage_holders(docs).withColumn("_holds", F.lit(True))
    cut = repeats.remove_repeats(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.aggregate("_removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("_removed").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
        F.array_join(F.transform("_removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed"),
        *(c.alias(name) for name, c in repeats.document(F.col("doc_id"), F.col("text")).items()),
    )
    return cut.join(holders, repeats.KEY, "left").select(*cut.columns[:-2], F.coalesce("_holds", F.lit(False)).alias("shares_passage"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document benchmark windows cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wm.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_found")
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        wm.hit_words().alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        wm.is_contaminated().alias("contaminated"),
    )


OP8 = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, m, array_to_string(w[i:i+m-1], ' ') AS win FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, m, i, array_to_string(w[i:i+m-1], ' ') AS win FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT rid, i, m, item FROM g JOIN p USING (m, win)),
h AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM o)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages of each document: how many, which, and ``license:start:end:differences`` of each."""
    docs = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_licenses")
    return docs.select(
        "doc_id",
        F.size("_licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_licenses", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("_licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), F.size(x["different"]).cast("string"))), ",").alias("passages"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of each document: how many it is linked with, the least id that links reach, and whether it stays."""
    joined = ngrams.similarity_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return joined.select("doc_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of each document, of which a tenth is read as if words repeated, and what remains of it. ``runs`` lists them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("n", F.when(F.col("h") % 10 == 0, F.nullif(mixing.word_count(F.col("text")), F.lit(0))))
    docs = docs.withColumn("a", F.col("g") % F.col("n"))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    found = periodic.periodic_runs(docs.select("doc_id", "text", "a", period.alias("p")), cycle=(F.col("a"), F.col("p")))
    longest = F.array_max(F.transform("_runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("_runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    found = found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), longest.alias("l"), F.when(F.size("_runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("runs"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("l.start")).alias("start"),
        F.col("l.length").alias("length"),
        (-F.col("l.period")).alias("period"),
        F.expr("1000 * l.length div -l.period").alias("exponent_milli"),
        F.sha2("runs", 256).alias("runs_sha256"),
        "collapsed_sha256",
        "runs",
    )


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; equal texts share a shard, and the shards' sizes are near equal. ``capacity``: the smallest that is feasible."""
    hashes = [c.alias(name) for c, name in zip(sharding.text_group(F.col("text")), ("g", "h"), strict=True)]
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", sharding.text_size(F.col("text")).alias("size"), crc.alias("text_crc32"), *hashes)
    dealt = sharding.shard(docs, size=F.col("size"), group=(F.col("g"), F.col("h")))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_capacity").alias("capacity"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, its cheapest edits, and the digest of what they make of it."""
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    found = conversations.repair(rows, conv="conv", copies=F.col("copies")).digests()
    return found.select(F.col("conv").alias("conv_id"), *conversations.COUNTS, "audit", F.col("sha256").alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_token_records, op4_secret_scan, op5_language, op6_near_vectors, op7_repeats, op8_decontaminate, op9_license_scan, op10_ngram_join, op11_periodic_runs, op12_shards, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL for those that SQL can express."""
    return {"op4_secret_scan": OP4, "op8_decontaminate": OP8}
