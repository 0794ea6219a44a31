"""Command lines: ``python -m provenant.cli build|search|ask|eval ...``; run them with spark-submit on a cluster.

Models are a service of chat completions, or named as ``module:attribute``: an encoder loader, a planner and a generator (tables in, tables out). Without them the stand-ins answer.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions.text import words
from provenant.operators import enrich, evaluate, flows, index, model, report, rules
from provenant.session import checkpointed
from provenant.sources import files, increments


def named(name: str | None, otherwise=None):
    """What ``module:attribute`` names."""
    if not name:
        return otherwise
    module, attribute = name.split(":")
    return getattr(importlib.import_module(module), attribute)


def build(spark: SparkSession, folder: str, out: str, load=None, version: str = "") -> DataFrame:
    """Bring chunks and index under ``out`` up to a folder of documents; returns the corpus report. Files that didn't change aren't read, and ids stay."""
    return increments.report(spark, increments.update(spark, folder, out, load, version=version).path)


def library(spark: SparkSession, out: str, load=None) -> flows.Library:
    """What ``build`` wrote, as a library."""
    out = increments.current(spark, out)
    chunks = files.read_chunks(spark, f"{out}/chunks")
    text = index.embedding_text(*(F.col(c) for c in ("doc_title", "chapter", "section", "alias", "text")))
    chunks = chunks.withColumns({"_words": F.array_distinct(words(text))})
    vectors, postings = index.read_index(spark, f"{out}/index")
    lists, blocks = index.read_search(spark, f"{out}/index")
    cases = enrich.cases(chunks)
    query = F.array_distinct(words(F.col("query_text")))
    return flows.Library(
        chunks=chunks, vectors=vectors.select("chunk_id", "vector"), postings=postings, terms=enrich.definition_terms(chunks), cases=cases.select("case_id", "keywords", "title"),
        members=chunks.where("kind = 'case'").select("chunk_id", F.concat("doc_id", F.lit("#"), "article_no").alias("case_id")),
        glossary=rules.glossary(spark), required=rules.required(spark), score=F.coalesce(F.size(F.array_intersect(query, "_words")) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0)), load=load or (lambda: index.hashing_encoder), lists=lists, blocks=blocks,
    )


def questions(spark: SparkSession, texts: list[str], mode: str = "auto") -> DataFrame:
    """Questions of a command line."""
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").withColumn("mode", F.lit(mode))


def evaluation(spark: SparkSession, x: flows.Library, path: str, ids: str = "") -> DataFrame:
    """Evaluation rows of a question file, retrieval only."""
    q = files.with_ids(files.read_questions(spark, path), ids)
    found = flows.search_all(q.select(F.col("id").alias("query_id"), F.col("question").alias("text")), x)
    hits = found.hits.select(F.col("query_id").alias("id"), F.lit(0).alias("search_no"), "hit_rank", "chunk_id", "score")
    none = F.array().cast("array<string>")
    shown = F.concat(F.coalesce("title", "case_id"), F.lit("("), F.format_number("score", 2), F.lit(")"))
    cases = found.cases.join(x.cases.select("case_id", "title"), "case_id", "left").groupBy(F.col("query_id").alias("id"))
    cases = cases.agg(F.transform(F.array_sort(F.collect_list(F.struct("case_rank", shown.alias("s")))), lambda c: c["s"]).alias("cases"))
    answers = found.gate.select(F.col("query_id").alias("id"), (~F.col("has_evidence")).alias("refused"), F.when(F.col("has_evidence"), "").otherwise("no_evidence").alias("reason"), F.lit("").alias("answer"), none.alias("cited"), none.alias("dropped")).join(cases, "id", "left")
    return evaluate.evaluation_rows(q, hits, answers)


def models(o: argparse.Namespace) -> dict:
    """Planner and generators that a command line names."""
    if not o.chat:
        return {"planner": named(o.planner), "model": named(o.generator)}
    call, how = model.chat(o.chat, o.model), {"settings": f"{o.chat} {o.model}"}
    return {"planner": model.planner(call, o.log, **how), "model": model.generator(call, o.log, model.QUESTION_RULES, **how), "scenario_model": model.generator(call, o.log, model.ASSESSMENT_RULES, **how)}


def everything(rows: DataFrame) -> None:
    """All rows, a line each, as they come; a result isn't held as a whole."""
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join(str(v) for v in r))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="provenant")
    parser.add_argument("--encoder")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, fields in (("build", ("folder", "out")), ("search", ("out", "text")), ("ask", ("out", "text")), ("eval", ("out", "questions"))):
        p = commands.add_parser(name)
        for f in fields:
            p.add_argument(f, nargs="+" if f == "text" else None)
        if name == "ask":
            p.add_argument("--mode", choices=("auto", "qa", "scenario"), default="auto")
        if name in ("ask", "eval"):
            p.add_argument("--planner")
            p.add_argument("--generator")
            p.add_argument("--chat", help="address of a service of chat completions, instead of --planner and --generator")
            p.add_argument("--model", default="", help="its model's name")
            p.add_argument("--log", help="folder of its replies, from which later runs go on")
        if name == "eval":
            p.add_argument("--full", action="store_true", help="answer the questions by --planner and --generator as well")
            p.add_argument("--ids", default="")
            p.add_argument("--details")
            p.add_argument("--page")
    o = parser.parse_args(args)
    if (o.command == "ask" or o.command == "eval" and o.full) and not (o.planner and o.generator or o.chat and o.log):
        parser.error("answers need --planner and --generator, or --chat and --log")
    spark = SparkSession.builder.appName("provenant").getOrCreate()
    load = named(o.encoder)
    if o.command == "build":
        everything(build(spark, o.folder, o.out, load, o.encoder or "").orderBy("doc_id"))
        return
    x = library(spark, o.out, load)
    if o.command == "search":
        found = flows.search_all(questions(spark, o.text).drop("mode"), x)
        everything(found.hits.join(x.chunks.select("chunk_id", "citation"), "chunk_id").select("query_id", "hit_rank", F.round("score", 3).alias("score"), "citation", "dense_rank", "sparse_rank").orderBy("query_id", "hit_rank"))
        everything(found.gate.orderBy("query_id"))
    elif o.command == "ask":
        given = flows.ask(questions(spark, o.text, o.mode), x, **models(o))
        everything(given.answers.select("query_id", "mode", "refused", "refuse_reason", "verdict", "final", "sections", "analysis").orderBy("query_id"))
        everything(given.references.orderBy("query_id", "n"))
    else:
        if o.full:
            asked = files.with_ids(files.read_questions(spark, o.questions), o.ids)
            rows = checkpointed(flows.evaluated(asked, x, **models(o)))
        else:
            rows = checkpointed(evaluation(spark, x, o.questions, o.ids))
        print(report.markdown(rows, full=o.full))
        if o.details:
            files.write_details(rows, o.details)
        if o.page:
            with open(o.page, "w", encoding="utf-8") as out:
                out.write(report.page(rows))


if __name__ == "__main__":
    main()
