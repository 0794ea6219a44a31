"""From a folder to documents: scan, read, clean, name, and drop copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import cleaning, dedupe
from provenant.session import checkpointed, small

from . import files


@dataclass
class Loaded:
    """``documents``: path, doc_id, doc_title, doc_type, access, version, effective_date, doc_no, status, lines; ``skipped``: path; ``copies``: dropped, kept, sim; ``registry``: path, doc_id."""

    documents: DataFrame
    skipped: DataFrame
    copies: DataFrame
    registry: DataFrame


def load(spark: SparkSession, folder: str, registry: DataFrame, overrides: DataFrame | None = None, readers: dict[str, files.Reader] | None = None, *, excluded_files: tuple[str, ...] = ()) -> Loaded:
    """Documents of a folder. ``registry``: path, doc_id of files that have an id; ``overrides``: file_name, doc_type, effective_date, status.

    Markdown says what it is in its front matter; other files are told by name, pages and overrides, and are read by ``readers`` (.docx by default).
    Files without a reader are skipped like those of other formats. Of documents that contain each other one stays.
    """
    readers = files.READERS | (readers or {})
    listed = checkpointed(files.scan(spark, folder, excluded_files=excluded_files).drop("content"))
    known = F.col("taken") & readable(readers)
    ids = checkpointed(dedupe.stable_ids(listed.where(known & (F.col("suffix") != ".md")).select("path"), registry))
    every, _ = read(spark, folder, listed.where(known), ids, overrides, readers, excluded_files=excluded_files, whole=True)
    pairs = dedupe.containment_pairs(checkpointed(shingles(every)), key="path")  # read more than once, and readers are dear
    copies = checkpointed(dedupe.resolve(checkpointed(pairs), preference(every)))
    return Loaded(dedupe.survivors(every, copies, key="path"), listed.where(~known).select("path"), copies, registry.select("path", "doc_id").unionByName(ids.select("path", "doc_id")).distinct())


def readable(readers: dict[str, files.Reader]) -> Column:
    """Suffixes that can be read."""
    return F.col("suffix").isin(".md", *readers)


def shingles(documents: DataFrame) -> DataFrame:
    """Sets of shingles of documents, by path."""
    return dedupe.shingle_sets(documents.select("path", F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("text")), key="path")


def preference(documents: DataFrame) -> DataFrame:
    """Which of two documents stays, by path."""
    return documents.select(F.col("path").alias("doc"), dedupe.file_preference(F.col("path")).alias("pref"))


def read(
    spark: SparkSession, folder: str, wanted: DataFrame, ids: DataFrame, overrides: DataFrame | None, readers: dict[str, files.Reader], cache: DataFrame | None = None, *, excluded_files: tuple[str, ...] = (), whole: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Documents of the files ``wanted`` (path, file_name, suffix, modified), and (digest, page, line_no, text) that readers gave for contents which ``cache`` lacks.

    Each content is read once. ``whole`` says that all files that can be read are wanted; otherwise only files that were changed at the same moments as wanted ones are opened.
    """
    moments = None if whole else files.Moments.of(wanted)

    def contents(*suffixes: str) -> DataFrame:
        x = files.scan(spark, folder, excluded_files=excluded_files, only=suffixes, moments=moments)
        return x if whole else x.join(small(wanted.select("path")), "path", "left_semi")

    told = files.read_markdown(contents(".md")).withColumns({"doc_no": F.lit(""), "status": F.lit("")})
    other = wanted.where("suffix <> '.md'")
    got = checkpointed(files.read_new(contents(*readers), readers, cache))
    fresh = got.select("digest", "page", "line_no", "text")
    if cache is not None:
        fresh = fresh.join(small(cache.where("line_no = -1").select("digest").distinct()), "digest", "left_anti").dropDuplicates(["digest", "line_no"])
        every = cache.select("digest", "page", "line_no", "text").dropDuplicates(["digest", "line_no"]).unionByName(fresh)
        got = got.where("line_no = -1").select("path", "digest").join(every, "digest")
    text = F.when(F.col("page").isNull(), cleaning.strip_tail(F.col("text"))).otherwise(F.col("text"))
    lines = checkpointed(got.where("line_no >= 0").select(F.col("path").alias("doc_id"), "page", "line_no", text.alias("text")).where("text <> ''"))
    kept = cleaning.clean_pages(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text", "page"))), lambda x: F.struct(x["text"].alias("text"), x["page"].cast("int").alias("page"))).alias("lines"))
    title, date = cleaning.title_and_date(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    named = other.select("path", "file_name", title.alias("title"), date.alias("name_date")).join(cleaning.page_metadata(lines).select(F.col("doc_id").alias("path"), F.col("date").alias("page_date"), "doc_no", F.col("status").alias("page_status")), "path", "left")
    none = spark.createDataFrame([], "file_name string, doc_type string, effective_date string, status string")
    named = cleaning.with_overrides(named, none if overrides is None else overrides)
    empty = F.array().cast("array<struct<text:string,page:int>>")
    rest = named.join(ids, "path").join(kept.withColumnRenamed("doc_id", "path"), "path", "left").select(
        "path", "doc_id", F.col("title").alias("doc_title"), "doc_type", F.array(F.lit(files.EVERYONE)).alias("access"), F.lit("").alias("version"), "effective_date", F.coalesce("doc_no", F.lit("")).alias("doc_no"), "status", F.coalesce("lines", empty).alias("lines")
    )
    return checkpointed(told.unionByName(rest)), fresh
