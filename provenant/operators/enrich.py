"""Rule joins on queries and chunks: expansion, required and named articles, definitions, cases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenant.functions.text import short_title
from provenant.session import checkpointed, small

from .matching import regex_join

# Forms of articles, definitions and case sections, and limits.
NUMERAL = "零〇一二三四五六七八九十百千"
NAMED_ARTICLE = rf"(第[{NUMERAL}]+条(?:之[一二三四五六七八九十]+)?)"
CALLED = r"所称([^，,。；（(“”\"]{2,15}?)[，,]?(?:是指|包括|指)"
LEADING = rf"^第[{NUMERAL}]+条(?U:\s*)([^，,。；：\s　]{{2,10}}?)(?:是指|包括)"
CALLED_PREFIX = r"^(本\S{0,3}所称|公司的)"
USED_AT_MOST, LEAST_TERM, DEFINITIONS = 0.2, 2, 2
CASE_SECTION = r"^(?:【([^】]{2,12})】|[一二三四五六七八九十]+、\s*(基本案情|诉讼过程|典型意义|裁判结果|检察机关履职过程|处理结果))\s*(.*)$"
NO_SECTION, KEYWORD_SECTION, KEYWORD_SPLIT = "正文", "关键词", r"(?U)[\s　、，,；;]+"
EXPANDED = ("（相关概念：", "；", "）")
#: Terms of a document that one automaton holds, and parts that its texts are dealt to.
TERMS_AT_ONCE, TERM_PARTS = 100_000, 8
#: Most parts that the rows of a key are dealt to.
MOST_PARTS = 64


def expand(queries: DataFrame, glossary: DataFrame, *, text: str = "text", expanded: str = "expanded") -> DataFrame:
    """Queries with the terms of all glossary patterns that they match in any case, in the glossary's order.

    A large glossary meets queries through literals of its patterns.
    """
    hits = regex_join(queries.select(F.col("query_id"), F.col(text).alias("_q")), glossary.select("ord", "pattern", "terms"), prefix="(?i)")
    terms = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "terms"))), lambda x: x["terms"]), EXPANDED[1]).alias("_t"))
    out = queries.join(terms, "query_id", "left")
    return out.withColumn(expanded, F.when(F.col("_t").isNull(), F.col(text)).otherwise(F.concat(F.col(text), F.lit(EXPANDED[0]), "_t", F.lit(EXPANDED[2])))).drop("_t")


def dealt(few: DataFrame, many: DataFrame, on: list[str]) -> DataFrame:
    """An equi-join of rows of which very many may have the same few keys: where keys are few, each one's ``many`` are dealt to parts, and its ``few`` are copied to these. Neither side is broadcast.

    The key and the part are one column, and the number of tasks is given, since what they read is little and what they give is much.
    """
    tasks = max(1, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = checkpointed(few)
    parts = max(1, min(MOST_PARTS, tasks // max(1, few.select(*on).distinct().count())))
    at = F.to_json(F.struct("_part", *on))
    left = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_at", at).drop("_part", *on)
    right = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(parts)).cast("int")).withColumn("_at", at).drop("_part", *on)
    return left.repartition(tasks, "_at").hint("shuffle_hash").join(right.repartition(tasks, "_at"), "_at").drop("_at")


def required_chunks(queries: DataFrame, rules: DataFrame, chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """Distinct (query_id, chunk_id) that rules ask for; patterns are case-sensitive, on the query as it was asked.

    What is found may be as much as queries times chunks; it is neither shuffled nor sorted, since both sides are distinct before they meet.
    """
    hits = regex_join(queries.select("query_id", F.col(text).alias("_q")), rules.select("pattern", "doc_title", "article")).select("query_id", "doc_title", "article").distinct()
    named = rules.select("doc_title", "article").distinct()
    known = chunks.select("chunk_id", "doc_title", "article").join(small(named), ["doc_title", "article"], "left_semi").distinct()
    return dealt(known, hits, ["doc_title", "article"]).select("query_id", "chunk_id")


def pinned_chunks(queries: DataFrame, chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """(query_id, chunk_id) of articles that a query names by number together with the document's short title.

    Whether a query names a title is found once for each title and article, not for each chunk.
    """
    articles = F.array_distinct(F.regexp_extract_all(text, F.lit(NAMED_ARTICLE)))
    named = queries.where(F.col(text).isNotNull()).select("query_id", F.col(text).alias("_q"), F.explode(articles).alias("article")).distinct()
    titled = chunks.select("chunk_id", short_title(F.col("doc_title")).alias("_title"), "article").where("article is not null and _title is not null").distinct()
    titles = titled.select("article", "_title").distinct()
    hits = named.join(titles, "article").where(F.contains("_q", F.col("_title"))).select("query_id", "article", "_title")
    return dealt(titled.join(hits.select("article", "_title").distinct(), ["article", "_title"], "left_semi"), hits, ["article", "_title"]).select("query_id", "chunk_id")


def held_terms(texts: DataFrame, terms: DataFrame, *, at_once: int = TERMS_AT_ONCE, key: str | None = None) -> DataFrame:
    """(doc, term): a row for each text (doc, text) and each of its document's terms (doc, term) that it holds; with the text's ``key`` between them if it is named.

    A document's terms come before its texts in a partition; an automaton is made of them and runs over the texts one by one, so the work grows with text and matches. The texts of
    a document are dealt to some partitions, each of which gets the terms.
    """
    block = F.floor((F.row_number().over(Window.partitionBy("doc").orderBy("term")) - 1) / at_once)
    known = checkpointed(terms.withColumn("block", block).groupBy("doc", "block").agg(F.collect_list("term").alias("terms")))
    heads = known.select("doc", "block", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1))).alias("part"), F.lit(0).alias("kind"), "terms")
    named = [key] if key else []
    bodies = texts.where("text is not null").join(known.select("doc", "block"), "doc").select("doc", "block", F.pmod(F.xxhash64("text"), F.lit(TERM_PARTS)).cast("int").alias("part"), F.lit(1).alias("kind"), "text", *named)
    order = ("doc", "block", "part")
    both = heads.unionByName(bodies, allowMissingColumns=True).repartition(*order).sortWithinPartitions(*order, "kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = None
        for frame in frames:
            docs, rows, held = [], [], []
            for i, (d, given, t) in enumerate(zip(frame["doc"], frame["terms"], frame["text"], strict=True)):
                if given is not None:
                    automaton = ahocorasick.Automaton()
                    for term in given:
                        automaton.add_word(term, term)
                    automaton.make_automaton()
                    continue
                mine = {term for _, term in automaton.iter(t)}
                docs += [d] * len(mine)
                rows += [i] * len(mine)
                held += mine
            keys = {key: frame[key].iloc[rows].to_numpy()} if key else {}
            yield pd.DataFrame({"doc": pd.Series(docs, dtype=frame["doc"].dtype), **keys, "term": pd.Series(held, dtype="object")})

    kinds = dict(texts.dtypes)
    return both.select("doc", "terms", "text", *named).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc", *named)) + ", term string")


def definition_terms(chunks: DataFrame, *, patterns: tuple[str, ...] = (CALLED, LEADING), doc: str = "doc_id", chunk: str = "chunk_id", text: str = "text", most: float = USED_AT_MOST) -> DataFrame:
    """(doc, chunk, term, usage): terms that a chunk defines and that at most a fifth of the document's chunks use.

    One automaton holds a document's terms, ``TERMS_AT_ONCE`` at most, and runs once over each of its chunks; only terms that a chunk holds become rows, which are counted.
    """
    found = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p)) for p in patterns))))
    terms = chunks.select(doc, chunk, F.explode(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, CALLED_PREFIX, "")))).alias("term")).where(F.length("term") >= LEAST_TERM)
    terms = checkpointed(terms)
    held = held_terms(chunks.select(F.col(doc).alias("doc"), F.col(text).alias("text")), terms.select(F.col(doc).alias("doc"), "term").distinct()).withColumnRenamed("doc", doc)
    total = chunks.groupBy(doc).agg(F.count("*").alias("_all"))
    usage = held.groupBy(doc, "term").agg(F.count("*").alias("_n")).join(total, doc).select(doc, "term", (F.col("_n") / F.col("_all")).alias("usage")).where(F.col("usage") <= most)
    return terms.join(usage, [doc, "term"]).select(doc, chunk, "term", "usage")


def attach_definitions(hits: DataFrame, terms: DataFrame, chunks: DataFrame, *, most: int = DEFINITIONS) -> DataFrame:
    """(query_id, chunk_id, def_rank): definitions of terms in hits of the same document, that aren't hits themselves, as they come.

    ``hits``: query_id, chunk_id, hit_rank; ``chunks``: chunk_id, doc_id, text, pos. A hit's terms are found once for all queries. Of a term's definitions, in their order, a query
    needs the first ``most`` that aren't hits, so no more than these and as many as are hits meet it: rows grow with the terms that hits hold, not with hits times definitions.
    """
    own = ["doc_id", "term"]
    defined = checkpointed(terms.select("doc_id", "chunk_id", "term").distinct().join(chunks.select("chunk_id", "pos"), "chunk_id"))
    texts = hits.select("chunk_id").distinct().join(chunks.select("chunk_id", F.col("doc_id").alias("doc"), "text"), "chunk_id")
    held = held_terms(texts, defined.select(F.col("doc_id").alias("doc"), "term").distinct(), key="chunk_id").withColumnRenamed("doc", "doc_id")
    met = hits.join(held, "chunk_id").groupBy("query_id", *own).agg(F.min("hit_rank").alias("hit_rank"))
    shown = hits.select("query_id", "chunk_id").distinct()
    passed = shown.join(defined, "chunk_id").groupBy("query_id", *own).agg(F.count("*").cast("int").alias("_passed"))
    wanted = met.join(passed, ["query_id", *own], "left").withColumn("_n", F.explode(F.sequence(F.lit(1), most + F.coalesce("_passed", F.lit(0)))))
    numbered = defined.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy("pos", "chunk_id")))
    found = wanted.join(numbered, [*own, "_n"]).join(shown, ["query_id", "chunk_id"], "left_anti")
    one = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hit_rank", "pos")).alias("_at"))
    return one.withColumn("def_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", "chunk_id"))).where(F.col("def_rank") <= most).select("query_id", "chunk_id", "def_rank")


def sections(text: Column, pattern: str = CASE_SECTION, otherwise: str = NO_SECTION) -> Column:
    """A case's text by section: map of name to text. A heading starts its section; the rest of its line belongs to it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(otherwise).alias("name"), F.array().cast("array<struct<name:string,line:string>>").alias("out"))

    def step(z: Column, line: Column) -> Column:
        found = F.trim(F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)))
        name = F.when(line.rlike(pattern), found).otherwise(z["name"])
        rest = F.trim(F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 3)).otherwise(line))
        add = F.when(rest != "", F.array(F.struct(name.alias("name"), rest.alias("line")))).otherwise(F.array().cast("array<struct<name:string,line:string>>"))
        return F.struct(name.alias("name"), F.concat(z["out"], add).alias("out"))

    rows = F.aggregate(lines, start, step, lambda z: z["out"])

    def by_name(r: Column) -> Column:
        names = F.array_distinct(F.transform(r, lambda x: x["name"]))
        body = lambda n: F.array_join(F.transform(F.filter(r, lambda x: x["name"] == n), lambda x: x["line"]), "\n")
        return F.map_from_arrays(names, F.transform(names, body))

    return F.transform(F.array(rows), by_name)[0]


def keywords(sections_: Column) -> Column:
    """Keywords of two characters or more, from the section of that name."""
    found = F.coalesce(F.try_element_at(sections_, F.lit(KEYWORD_SECTION)), F.lit(""))
    return F.filter(F.split(found, KEYWORD_SPLIT), lambda k: F.length(k) >= LEAST_TERM)


def cases(chunks: DataFrame) -> DataFrame:
    """A row for each case: case_id, title, source, full_text, sections, keywords, citation.

    ``chunks`` has doc_id, doc_title, article_no, article, text, page_start, page_end, pos; those of kind case count.
    """
    x = chunks.where("kind = 'case'").withColumn("case_id", F.concat(F.col("doc_id"), F.lit("#"), F.col("article_no")))
    body = F.when(F.contains("text", F.lit("\n")), F.expr("substring(text, locate('\n', text) + 1)")).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("body")))), lambda p: p["body"])
    x = x.groupBy("case_id").agg(
        F.min_by(F.split("article", "·")[0], "pos").alias("title"),
        F.min_by("doc_title", "pos").alias("source"),
        F.array_join(parts, "\n").alias("full_text"),
        F.least(F.min(F.nullif("page_start", F.lit(0))), F.min(F.nullif("page_end", F.lit(0)))).alias("_a"),
        F.greatest(F.max("page_start"), F.max("page_end")).alias("_b"),
    )
    x = x.withColumn("sections", sections(F.col("full_text"))).withColumn("keywords", keywords(F.col("sections")))
    pages = F.when(F.col("_a") == F.col("_b"), F.concat(F.lit(" 第"), "_a", F.lit("页"))).when(F.col("_a").isNotNull(), F.concat(F.lit(" 第"), "_a", F.lit("-"), "_b", F.lit("页"))).otherwise("")
    return x.withColumn("citation", F.concat(F.lit("《"), "source", F.lit("》 "), "title", pages)).drop("_a", "_b")
