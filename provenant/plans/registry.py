"""The registered queries of the engine's own operators, over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import text as fn
from provenant.functions.shingles import with_shingles
from provenant.operators import answer, cleaning, dedupe, enrich, evaluate, lists, retrieve, segment, verify

from provenant.session import checkpointed, shared_path

from . import tables
from .tables import table

# ---- cleaning and metadata


def clean_junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without junk lines and line tails."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: cleaning.strip_tail(x, tables.TAIL)), lambda x: ~cleaning.is_junk(x, tables.JUNK))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.size(kept).alias("n_kept"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in a twentieth of a source's documents."""
    x = tables.lines(table(spark, sf_dir, "documents").select("source", "doc_id", "text").withColumn("k", F.struct("source", "doc_id")), "k").select("k.source", "k.doc_id", "text")
    return cleaning.running_lines(x, doc="source", page="doc_id", share=0.05)


def page_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand on a fiftieth of a site's pages."""
    return cleaning.running_lines(tables.page_lines(table(spark, sf_dir, "pages")), doc="site", page="page_id", share=0.02)


def classify_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a page's address meets."""
    return table(spark, sf_dir, "pages").select("page_id", cleaning.first_match(F.col("url"), tables.URL_LEVELS, "other").alias("level"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as quotations are compared."""
    x = fn.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(x).alias("n"), F.md5(x).alias("normalized_md5"))


# ---- ids and copies


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all addresses: those of secure ones are registered, others are new."""
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    from pyspark.sql import Window

    registry = urls.where("path like 'https:%'").select("path", F.format_string(dedupe.ID_FORMAT, F.row_number().over(Window.orderBy("path"))).alias("doc_id"))
    return dedupe.stable_ids(urls, registry)


def char_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct shingles of each document."""
    return with_shingles(table(spark, sf_dir, "documents").select("doc_id", "text"), sets=False).withColumnRenamed("n", "n_shingles")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.containment_pairs(table(spark, sf_dir, "documents"))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain each other."""
    return _pairs(spark, sf_dir).select("a", "b", "shared", F.round("sim", 6).alias("sim"))


def dedupe_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document survives; of two the one with the lesser (language, length of source) stays."""
    d = table(spark, sf_dir, "documents")
    preference = d.select(F.col("doc_id").alias("doc"), F.struct(F.col("lang"), F.length("source")).alias("pref"))
    report = dedupe.resolve(checkpointed(_pairs(spark, sf_dir)), preference)
    return d.select("doc_id").join(report.select(F.col("dropped").alias("doc_id"), F.lit(False).alias("_s")), "doc_id", "left").select("doc_id", F.coalesce("_s", F.lit(True)).alias("survives"))


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that contain each other."""
    return dedupe.contained_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "shared", F.round("sim", 6).alias("sim"))


# ---- segmentation


def segment_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in groups that start at a marker, long groups cut between lines, all packed to 1200 characters."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    start = F.struct(F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))
    number = F.aggregate("lines", start, lambda z, t: F.struct((z["g"] + t.rlike(tables.MARKER).cast("int")).alias("g"), F.concat(z["out"], F.array(z["g"] + t.rlike(tables.MARKER).cast("int"))).alias("out")), lambda z: z["out"])
    # a document's first group starts at its first line, whether that is a marker or not
    rows = x.select("doc_id", F.posexplode(F.arrays_zip(F.transform("lines", F.length).alias("size"), number.alias("g"))).alias("pos", "x")).select("doc_id", "pos", "x.size", "x.g")
    groups = rows.groupBy("doc_id", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "size"))), lambda s: s["size"]).alias("sizes"))
    whole = F.aggregate("sizes", F.lit(0), lambda n, s: n + s)
    at = F.when(whole <= segment.PACK, F.transform("sizes", lambda s: F.lit(0))).otherwise(segment.packed(F.col("sizes")))
    units = F.transform(F.array_distinct(at), lambda u: F.aggregate(F.filter(F.zip_with("sizes", at, lambda s, a: F.when(a == u, s)), lambda s: s.isNotNull()), F.lit(0), lambda n, s: n + s))
    docs = groups.select("doc_id", "g", units.alias("units")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "units"))), lambda s: s["units"])).alias("units"))
    packs = segment.packed(F.col("units"))
    size = lambda p: F.aggregate(F.zip_with("units", packs, lambda s, a: F.when(a == p, s).otherwise(0)), F.lit(0), lambda n, s: n + s)
    return docs.select("doc_id", F.size("units").alias("n_units"), F.array_join(F.transform(F.array_distinct(packs), size).cast("array<string>"), ",").alias("chunk_sizes"))


def chunk_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a chunk, named by its first word: unique ids and citations."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    x = tables.lines(d.withColumn("k", F.struct("doc_id", "lang", "source")), "k").select("k.*", "line_no", F.regexp_extract("text", r"^([^ ]*)", 1).alias("label"))
    n = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("line_no"))
    x = x.withColumns({"n": n, "page": (F.col("line_no") / 10).cast("int") + 1})
    cid = F.concat(F.col("doc_id"), F.lit("#"), "label", F.when(F.col("n") > 1, F.concat(F.lit("("), "n", F.lit(")"))).otherwise(""))
    alias = F.when(F.col("label") == "The", "article").otherwise("")
    return x.select("doc_id", "line_no", cid.alias("chunk_id"), segment.citation(F.col("source"), F.col("lang"), F.lit(""), F.col("label"), alias, F.col("page"), F.col("page") + F.col("line_no") % 2).alias("citation"))


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source: number, languages, the longest."""
    d = table(spark, sf_dir, "documents")
    report = segment.corpus_report(d.select(F.col("source").alias("doc_id"), F.col("lang").alias("kind"), "text"))
    levels = evaluate.titles_by_level(d, level="source", title="lang").select(F.col("source").alias("doc_id"), F.array_join("titles", ",").alias("titles"))
    return report.join(levels, "doc_id").select(F.col("doc_id").alias("source"), "n_chunks", "kinds", "longest", "titles")


# ---- rule joins


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns with the terms that the glossary adds."""
    return enrich.expand(tables.user_turns(spark, sf_dir), tables.glossary(spark)).select("query_id", "expanded")


def required_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that rules require for users' turns."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_title"), F.col("source").alias("article"))
    return enrich.required_chunks(tables.user_turns(spark, sf_dir), tables.required_rules(spark), d)


def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that at most a fifth of a source's documents use."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return enrich.definition_terms(d, patterns=(tables.TERMS,), doc="source", chunk="doc_id").select("source", "doc_id", "term", F.round("usage", 6).alias("usage"))


def case_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as cases, turns as their parts, sections by role."""
    c = table(spark, sf_dir, "conversations")
    x = c.select(
        F.lit("talk").alias("doc_id"), F.lit("Talks").alias("doc_title"), F.lit("case").alias("kind"), F.col("conv_id").alias("article_no"), F.concat(F.lit("Talk "), "conv_id", F.lit("·"), "role").alias("article"),
        F.concat(F.lit("head\n【"), "role", F.lit("】"), "text").alias("text"), (F.col("turn") + 1).cast("int").alias("page_start"), (F.col("turn") + 1).cast("int").alias("page_end"), F.col("turn").alias("pos"),
    )
    found = enrich.cases(x)
    return found.select("case_id", "title", "citation", F.md5("full_text").alias("full_md5"), F.explode("sections").alias("section", "_t")).withColumn("section_md5", F.md5("_t")).drop("_t")


# ---- retrieval


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all: the 30 with the largest cosine."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieve.dense_top(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def dense_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_topk, through an index of lists that is written and read again."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    path = shared_path(spark, "lists")
    lists.write_lists(e, path)
    found = lists.read_lists(spark, path).search(e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector"))
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 documents that share most words with each benchmark item."""
    return tables.corpus(spark, sf_dir).sparse().select("query_id", "chunk_id", "rank", "score")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings fused."""
    return tables.corpus(spark, sf_dir).fused().select("query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("rrf", 9).alias("rrf"), "fused_rank")


def _search(spark: SparkSession, sf_dir: str, k: int = retrieve.TOP_K) -> tuple[tables.Corpus, DataFrame]:
    c = tables.corpus(spark, sf_dir)
    same = c.queries.select("query_id", F.col("query_id").alias("chunk_id"))
    pinned = same.join(c.chunks.where(F.col("doc_type") != tables.CASE_LANG).select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id")
    named = c.chunks.select("chunk_id", F.col("doc_type").alias("doc_title"), F.col("source").alias("article"))
    required = enrich.required_chunks(c.queries, tables.required_rules(spark), named)
    hits = retrieve.search(c.queries, c.dense(), c.sparse(), c.scored, tables.word_score(), pinned=pinned, required=required, is_capped=F.col("doc_type") == tables.CAPPED_LANG, k=k)
    return c, checkpointed(hits)  # some rows a query, which what follows reads several times


def rerank_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits: document with the item's number pinned, Spanish ones capped, required ones added."""
    return _search(spark, sf_dir)[1].select("query_id", "chunk_id", "pinned", "required", F.round("score", 6).alias("score"), "hit_rank")


def _cases(c: tables.Corpus) -> DataFrame:
    """The cases of each query: a few rows, kept."""
    if "cases" not in c.kept:
        c.kept["cases"] = checkpointed(_find_cases(c))
    return c.kept["cases"]


def _find_cases(c: tables.Corpus) -> DataFrame:
    first = F.lower(F.regexp_extract("text", r"^(\p{L}+)", 1))
    keywords = c.chunks.where(F.col("doc_type") == tables.CASE_LANG).select(F.col("source").alias("case_id"), first.alias("w")).where(F.length("w") >= 4).groupBy("case_id").agg(F.array_sort(F.collect_set("w")).alias("keywords"))
    members = c.scored.withColumn("case_id", F.col("source"))
    return retrieve.case_matches(c.queries, c.fused(case=True), members, keywords, tables.word_score())


def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents by source as cases: the best three."""
    return _cases(tables.corpus(spark, sf_dir)).select("query_id", "case_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join(F.array_sort("matched"), ",").alias("matched"), "case_rank")


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each item has evidence."""
    c, hits = _search(spark, sf_dir)
    return retrieve.evidence(c.queries, hits, _cases(c)).select("query_id", F.round("top_score", 6).alias("top_score"), "has_evidence")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: hits of each benchmark item with citation and whether it has evidence."""
    c, hits = _search(spark, sf_dir)
    gate = retrieve.evidence(c.queries, hits, _cases(c))
    cited = c.chunks.select("chunk_id", segment.citation(F.col("source"), F.col("doc_type"), F.lit(""), F.col("chunk_id").cast("string"), F.lit(""), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("citation"))
    return hits.join(gate, "query_id").join(cited, "chunk_id").select("query_id", "hit_rank", "chunk_id", "citation", "dense_rank", "sparse_rank", F.round("score", 6).alias("score"), "has_evidence")


# ---- answering


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way users' turns go."""
    return tables.user_turns(spark, sf_dir).select("query_id", answer.intent(F.col("text"), asking=tables.ASKING, plans=tables.PLANS).alias("intent"))


def merge_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items each as a main search and its sub-searches, merged."""
    hits = _search(spark, sf_dir)[1]
    x = hits.select(F.expr("query_id div 4").alias("query_id"), (F.col("query_id") % 4).cast("int").alias("search_no"), "hit_rank", "chunk_id", "score")
    return answer.merge_searches(x).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "merged_rank")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[tables.Corpus, DataFrame]:
    c, hits = _search(spark, sf_dir)
    definitions = c.fused().where("fused_rank > 24").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    definitions = retrieve.top(definitions, enrich.DEFINITIONS, F.asc("fused_rank"), rank="def_rank")
    return c, answer.number_sources(hits, definitions, _cases(c))


def number_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2 .. over hits, two further ones as definitions, and cases."""
    return _sources(spark, sf_dir)[1]


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, sources = _sources(spark, sf_dir)
    full = sources.join(c.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "source", "chunk_id", "text", F.lit("").alias("alias"))
    quote = F.concat(F.substring("text", 1, 40), F.lit("……"), F.substring("text", 61, 30))
    x = c.queries.select("query_id", quote.alias("quote"), F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f"[S{n}]").alias("source")) for i, n in enumerate((1, 2, 3, 4, 5, 99))))).alias("c"))
    return verify.check_citations(x.select("query_id", "c.ord", "c.source", "quote"), full), full


def verify_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotation from each item against five of its sources and one that doesn't exist."""
    return _checked(spark, sf_dir)[0].select("query_id", "ord", "source", "chunk_id", "valid", "reason")


MARKED = "See [S3] and [S1]; not [S99], nor [S4]. [S1] again."


def scrub_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each item without the marks of sources whose quotation failed, and numbered anew."""
    checked, sources = _checked(spark, sf_dir)
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(MARKED).alias("text"))
    cleaned = verify.scrub_marks(answers, checked)
    final, references = answer.renumber(cleaned, checked, sources)
    n = references.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source"))), lambda r: r["source"]), ",").alias("references"))
    return final.join(n, "query_id", "left").select("query_id", "cleaned", "final", F.coalesce("references", F.lit("")).alias("references"))


# ---- evaluation


def keypoint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points that documents lack."""
    must = F.array(*map(F.lit, tables.MUST))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.missing_points(F.col("text"), must), ",").alias("missing"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, hits = _search(spark, sf_dir)
    gold = benchmark_containment(spark, sf_dir).groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set("doc_id")).alias("gold"))
    i = F.col("query_id")
    kind = F.when(i % 5 == 4, "out_of_kb").when(i % 5 == 3, "scenario").otherwise("normal")
    questions = c.queries.select(i.alias("id"), kind.alias("type"), F.when(kind == "out_of_kb", "refuse").otherwise("answer").alias("expect"), F.array(F.lit("tion|ment"), F.lit("1000")).alias("must"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("expect_case")).join(gold, "id", "left")
    gate = retrieve.evidence(c.queries, hits, _cases(c))
    refused = ~F.col("has_evidence") | (F.col("query_id") % 7 == 0)
    cited = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit_rank") <= 3, F.struct("hit_rank", "chunk_id")))), lambda h: h["chunk_id"]).alias("_cited"))
    shown = _cases(c).groupBy("query_id").agg(F.array_sort(F.collect_list(F.concat_ws("@", "case_id", "case_rank"))).alias("cases"))
    empty = F.array().cast(T.ArrayType(T.LongType()))
    x = gate.join(cited, "query_id", "left").join(shown, "query_id", "left").join(c.queries.select("query_id", "text"), "query_id")
    answers = x.select(
        F.col("query_id").alias("id"), refused.alias("refused"), F.when(refused, "no_evidence").otherwise("").alias("reason"), F.when(~refused, F.col("text")).otherwise("").alias("answer"),
        F.when(refused, empty).otherwise(F.coalesce("_cited", empty)).alias("cited"), F.when(F.col("query_id") % 4 == 1, F.array(F.lit("S1 x"))).otherwise(F.array().cast("array<string>")).alias("dropped"), F.col("cases").alias("cases"),
    )
    found = hits.select(F.col("query_id").alias("id"), F.lit(0).alias("search_no"), "hit_rank", "chunk_id", "score")
    return evaluate.evaluation_rows(questions, found, answers)


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each item as a question: gold are the documents that contain it."""
    listed = ("gold", "cited", "missing_points", "cases_shown", "retrieved")
    x = _rows(spark, sf_dir).drop("answer", "dropped_detail", "question", "verdict", "key", "seconds")  # these are compared in full_evaluation
    return x.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in listed})


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics by type, and over all."""
    rows = _rows(spark, sf_dir)
    by = evaluate.metrics(rows, "type")
    return by.unionByName(evaluate.metrics(rows).withColumn("type", F.lit("all")))


def metric_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as they are shown."""
    from provenant.operators.report import metric_table

    return metric_table(_rows(spark, sf_dir)).select("metric", "value")


def answer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of turns by role; a turn that starts with a vowel counts as refused."""
    c = table(spark, sf_dir, "conversations")
    return evaluate.mean_length(c.select(F.col("role").alias("type"), F.col("text").rlike("^[AEIOU]").alias("refused"), F.col("text").alias("answer")))


def failure_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong with each item."""
    rows = _rows(spark, sf_dir)
    return evaluate.failures(rows).join(evaluate.issue_tags(rows).select("id", F.array_join("tags", "；").alias("tags")), "id")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals under other gates."""
    return evaluate.threshold_sweep(_rows(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {
        f.__name__: f
        for f in (
            clean_junk_lines, running_lines, page_boilerplate, classify_level, normalize_text, stable_ids, char_shingles, near_dup_pairs, dedupe_survivors, benchmark_containment,
            segment_by_marker, chunk_citation, corpus_report, expand_query, required_evidence, definition_terms, case_aggregate,
            dense_topk, dense_lists, sparse_topk, rrf_fuse, rerank_cap_topk, case_search, evidence_gate, hybrid_search,
            route_intent, merge_searches, number_sources, verify_quotes, scrub_marks,
            keypoint_coverage, eval_rows, eval_metrics, metric_ratios, answer_length, failure_list, threshold_sweep,
        )
    }
