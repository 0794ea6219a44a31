"""Checks of citations against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import quote_in_text

# Fixed values.
NO_SOURCE, NOT_VERBATIM = "来源编号不存在", "引句与原文不符"
MARK = r"\[S(\d+)\]"


def without_alias(quote: Column, alias: Column) -> Column:
    """A quotation without the alias that its source's citation carries."""
    return F.when(F.coalesce(alias, F.lit("")) != "", F.replace(quote, F.concat(F.lit("【"), alias, F.lit("】")), F.lit(""))).otherwise(quote)


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (query_id, ord, source, quote) with chunk_id, valid, reason; ``sources``: query_id, source, chunk_id, text, alias."""
    c = citations.withColumn("source", F.trim(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit("[] "))).withColumn("quote", F.coalesce("quote", F.lit("")))
    x = c.join(sources.select("query_id", "source", "chunk_id", F.col("text").alias("_text"), F.col("alias").alias("_alias"), F.lit(True).alias("_known")), ["query_id", "source"], "left")
    valid = F.col("_known").isNotNull() & quote_in_text(without_alias(F.col("quote"), F.col("_alias")), F.col("_text"))
    reason = F.when(F.col("_known").isNull(), NO_SOURCE).when(~valid, NOT_VERBATIM).otherwise("")
    return x.select(*c.columns, "chunk_id", valid.alias("valid"), reason.alias("reason"))


def scrub_marks(answers: DataFrame, checked: DataFrame, *, text: str = "text", cleaned: str = "cleaned") -> DataFrame:
    """Answers (query_id, and a text or an array of texts) without the marks of sources that have no valid quotation."""
    good = checked.where("valid").groupBy("query_id").agg(F.collect_set("source").alias("_good"))
    x = answers.join(good, "query_id", "left").withColumn("_good", F.coalesce("_good", F.array().cast("array<string>")))

    def scrubbed(t: Column) -> Column:
        marks = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(MARK)), lambda n: F.concat(F.lit("S"), n)))
        return F.aggregate(F.filter(marks, lambda m: ~F.array_contains("_good", m)), t, lambda u, m: F.replace(u, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))

    many = dict(answers.dtypes)[text].startswith("array")
    return x.withColumn(cleaned, F.transform(text, scrubbed) if many else scrubbed(F.col(text))).drop("_good")
