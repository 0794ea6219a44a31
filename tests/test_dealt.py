"""Joins on few keys that very many rows have."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import enrich


def test_a_rule_that_all_meet_is_dealt(spark):
    """One key on both sides: neither one task nor a shuffle of what is found."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        queries = spark.range(300).select(F.col("id").alias("query_id"), F.lit("en 第八条和第八条").alias("text"))
        chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.lit("en").alias("doc_title"), F.lit("第八条").alias("article"))
        rule = spark.createDataFrame([("en", "en", "第八条"), ("第", "en", "第八条")], "pattern string, doc_title string, article string")
        for found in (enrich.required_chunks(queries, rule, chunks.union(chunks)), enrich.pinned_chunks(queries.union(queries), chunks.union(chunks))):
            assert found.count() == found.distinct().count() == 300 * 200
            sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 300 * 200 * 0.7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
