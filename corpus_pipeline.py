"""A corpus pipeline: quality, near copies, decontamination, mixing, token records.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the columns of
documents but for the last, which returns a row for each record of the token files. ``run`` applies them in turn,
with what each returns written as Parquet and read again.

Null texts, empty texts and repeated rows have the results that the operators' docstrings state; extra columns pass
through the first four stages; an empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import decontaminate, mixing, ngrams, quality, tokens
from provenant.llm.common import discard, stage
from provenant.llm.queries import held_out, table

#: Score from which a document is kept.
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; a text without words can't be judged by its form and is kept."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality.score(docs, model)
    wordless = mixing.word_count(F.col("text")) == 0
    return scored.where((F.col("_score") >= LEAST_QUALITY) | wordless).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return ngrams.similarity_join(docs).where("_kept").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.is_contaminated()).select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in shards that are shuffled one by one."""
    return mixing.shuffled(mixing.mix(docs)).select(docs.columns)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records of all rows, written and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    out = tokens.token_output(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_to_weights),
    ("token-ID / binary output", write_records),
]

#: Training a classifier and drawing a random mix aren't SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
        discard(*before)  # each stage's rows go when the next has read them
        before = [docs]
    return docs
