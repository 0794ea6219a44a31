"""Queries of what reads and cleans files, of rules, of the index and of the sinks, over the test tables, and their DuckDB SQL.

Names, titles, lines and questions that the test tables lack are made from documents by expressions that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import text as fn
from provenant.operators import answer, cleaning, dedupe, enrich, index, retrieve, rules, verify
from provenant.session import shared_path
from provenant.sources import files

from . import tables
from .chunking import num, numeral, rx, sql_number
from .oracles import lit

NAME = """concat(CASE WHEN doc_id % 3 = 0 THEN concat(doc_id % 50, '.') ELSE '' END, source, '关于', lang, '的规定',
CASE doc_id % 5 WHEN 1 THEN concat('_', CAST(20200101 + doc_id % 28 AS INT)) WHEN 2 THEN '_国务院文件_中国政府网' WHEN 3 THEN '-陕西法院网' WHEN 4 THEN '_国家外汇管理局门户网站' ELSE '_2020' END)"""
TITLE = """concat(CASE doc_id % 3 WHEN 1 THEN '【现行】' ELSE '' END, CASE doc_id % 11 WHEN 0 THEN '典型案例之一' WHEN 1 THEN '最高人民法院关于适用法律的解释' WHEN 2 THEN '中华人民共和国反洗钱法' WHEN 3 THEN '全国人民代表大会常务委员会关于惩治犯罪的决定'
WHEN 4 THEN '外汇管理条例' WHEN 5 THEN '国务院关于外汇的通知' WHEN 6 THEN '个人外汇管理办法' WHEN 7 THEN '关于印发管理办法的通知' WHEN 8 THEN '结汇规定' WHEN 9 THEN '中华人民共和国刑法（节选）' ELSE '通知' END, CASE doc_id % 4 WHEN 2 THEN '（2020年修正）' ELSE '' END)"""
#: Lines of scanned pages: i from 0, seven a page; a head on each page, page numbers, junk and metadata among the text t.
PAGE_LINE = """CASE WHEN i % 7 = 0 THEN concat('内部资料 ', source) WHEN i % 7 = 1 THEN CASE WHEN i % 3 = 0 THEN CAST(CAST(floor(i / 7) AS INT) + 1 AS STRING) ELSE t END WHEN i % 7 = 6 THEN CAST(CAST(floor(i / 7) AS INT) + 1 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS STRING)
WHEN i % 23 = 2 THEN '发布日期：2023-5-17' WHEN i % 19 = 3 THEN '文  号：汇发〔2023〕12号' WHEN i % 29 = 4 THEN '（已废止）' WHEN i % 13 = 5 THEN '打印' WHEN i % 17 = 5 THEN 'https://www.example.gov.cn/a' WHEN i % 11 = 4 THEN '- 3 -' WHEN i % 31 = 5 THEN '2024/1/2 10:30' ELSE t END"""
PATH = "concat('in/', source, '/', substring(coalesce(text, ''), 1, doc_id % 9), CASE doc_id % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.md' WHEN 3 THEN '.doc' ELSE '.txt' END)"
OVERRIDES = (("src1", "司法解释", "2019-01-01", ""), ("src2", "", "", "已废止"), ("src3", "法律", "", "部分失效"))
ASKS = f"concat(CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN '刑法' ELSE '' END, '第', {num('turn % 12 + 1')}, '条和第', {num('conv_id % 15 + 1')}, '条之一：', text)"
TITLES = ("en", "de", "中华人民共和国刑法（2020修正）")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and dates from file names."""
    title, date = cleaning.title_and_date(F.expr(NAME))
    return docs(spark, sf_dir).select("doc_id", title.alias("title"), date.alias("date"))


def authority_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of authority and short titles."""
    t = F.expr(TITLE)
    return docs(spark, sf_dir).select("doc_id", cleaning.authority_level(t).alias("level"), fn.short_title(t).alias("short"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = docs(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    return x.select("doc_id", F.when(F.col("doc_id") % 10 == 9, None).otherwise(F.floor(F.col("i") / 7).cast("int") + 1).alias("page"), F.col("i").alias("line_no"), F.expr(PAGE_LINE).alias("text"))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages without junk, running lines and page numbers."""
    return cleaning.clean_pages(_pages(spark, sf_dir)).select("doc_id", "page", "line_no", F.md5("text").alias("text_md5"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, number and status that pages tell."""
    return cleaning.page_metadata(_pages(spark, sf_dir))


def metadata_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, date and status by precedence: name, page, override."""
    over = spark.createDataFrame(list(OVERRIDES), "file_name string, doc_type string, effective_date string, status string")
    _, date = cleaning.title_and_date(F.expr(NAME))
    x = docs(spark, sf_dir).select("doc_id", F.col("source").alias("file_name"), F.expr(TITLE).alias("title"), date.alias("name_date")).join(cleaning.page_metadata(_pages(spark, sf_dir)).select("doc_id", F.col("date").alias("page_date"), F.col("status").alias("page_status")), "doc_id", "left")
    return cleaning.with_overrides(x, over).select("doc_id", "doc_type", "effective_date", "status")


def chinese_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals as numbers."""
    return docs(spark, sf_dir).select("doc_id", fn.chinese_number(F.expr(f"CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 500 AS STRING) ELSE {num('doc_id % 199 + 1')} END")).cast("int").alias("value"))


def prefer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides between copies of a file."""
    x = docs(spark, sf_dir).select("doc_id", dedupe.file_preference(F.expr(PATH)).alias("p"))
    return x.select("doc_id", F.col("p.rank").alias("suffix_rank"), F.col("p.length").alias("name_length"))


def offence_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of offences by article."""
    x = docs(spark, sf_dir).select("doc_id", F.expr(f"CASE WHEN doc_id % 2 = 0 THEN '{rules.CRIMINAL_LAW}' ELSE '别的法' END").alias("doc_title"), F.expr(f"concat('第', {num('doc_id % 199 + 1')}, '条')").alias("article"))
    return rules.with_alias(x).select("doc_id", "doc_title", "article", "alias")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.expr(ASKS).alias("text"))


def pinned_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that users name together with the law."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % 3 + 1).cast("int"))
    chunks = docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), title.alias("doc_title"), F.expr(f"concat('第', {num('doc_id % 16 + 1')}, '条', CASE WHEN doc_id % 5 = 0 THEN '之一' ELSE '' END)").alias("article"))
    return enrich.pinned_chunks(_asked(spark, sf_dir), chunks)


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is encoded of each document."""
    x = index.embedding_text(F.col("source"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '节' ELSE '' END"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END"), F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).select("doc_id", F.md5(x).alias("text_md5"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.lit("")
    return docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("source").alias("doc_title"), F.when(F.col("lang") == "fr", retrieve.CASE_TYPE).otherwise("法律").alias("doc_type"), empty.alias("chapter"), empty.alias("section"), empty.alias("alias"),
        F.coalesce("text", empty).alias("text"), F.col("n_chars").cast("int").alias("article_no"), F.when(F.col("doc_id") % 2 == 0, F.lit(3)).alias("page_start"),
    )


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as it is written and read again: tokens of each chunk, the length of its vector's sum, and its channel."""
    path = shared_path(spark, "index")
    index.write_index(*index.build_rows(_chunks(spark, sf_dir)), path)
    vectors, postings = index.read_index(spark, path)
    tokens = postings.groupBy("chunk_id").agg(F.count("*").alias("n_tokens"), F.sum("weight").cast("long").alias("weight"), F.max("token").alias("last"))
    pairs = F.aggregate("vector", F.lit(0.0), lambda n, x: n + x).cast("long")
    return vectors.select("chunk_id", "doc_title", "article_no", "page_start", "is_case", pairs.alias("pairs")).join(tokens, "chunk_id", "left")


def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they are written as JSON lines and read again."""
    path = shared_path(spark, "chunks")
    files.write_chunks(_chunks(spark, sf_dir), path)
    x = files.read_chunks(spark, path)
    return x.select("chunk_id", "doc_id", "doc_type", "article_no", "page_start", F.md5("text").alias("text_md5"))


def stored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from chunks that were written as JSON lines and read again: each document is a case in packs of three lines, many of them more than ten."""
    path = shared_path(spark, "cases")
    x = tables.lines(docs(spark, sf_dir).where("text is not null").select("doc_id", "text", "source").withColumn("key", F.struct("doc_id", "source")), key="key")
    k = F.floor(F.col("line_no") / 3)
    packs = x.groupBy("key", k.alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda z: z["text"]).alias("lines"))
    name = F.concat(F.lit("案例1 甲·"), F.when(F.col("pos") % 2 == 0, "正文").otherwise("典型意义"))
    cut = packs.select(
        F.concat("key.doc_id", F.lit("#"), name, F.lit("("), F.col("pos") + 1, F.lit(")")).alias("chunk_id"), F.col("key.doc_id").cast("string").alias("doc_id"), F.col("key.source").alias("doc_title"), F.lit("case").alias("kind"), name.alias("article"),
        F.lit(1).alias("article_no"), F.concat(name, F.lit("\n"), F.array_join("lines", "\n")).alias("text"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), "pos",
    )
    files.write_chunks(cut.repartition("chunk_id"), path)
    return enrich.cases(files.read_chunks(spark, path)).select("case_id", "title", "source", F.md5("full_text").alias("text_md5"))


def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of plans: at most five, none without a query; plans that can't be read have none."""
    parts = F.transform(F.split("text", r"\. ?"), lambda t: F.struct(t.alias("query"), F.lit("x").alias("why")))
    raw = F.when(F.col("item_id") % 5 == 3, F.lit("not JSON")).otherwise(F.to_json(F.struct(F.lit("s").alias("summary"), parts.alias("issues"))))
    return answer.plan_issues(tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), raw.alias("raw"))).select("query_id", "search_no", F.md5("text").alias("text_md5"))


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that become refusals."""
    x = tables.table(spark, sf_dir, "benchmark").select("item_id", F.lit("an answer").alias("final"), F.lit("yes").alias("verdict"))
    reason = F.expr(f"CASE item_id % 4 WHEN 0 THEN '{answer.NO_EVIDENCE}' WHEN 1 THEN '' WHEN 2 THEN '{answer.CITATION_FAILED}' END")
    return answer.refuse(x, reason).select("item_id", "refused", "refuse_reason", "final", "verdict")


def alias_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations that carry the alias of their source."""
    x = docs(spark, sf_dir).where("text is not null").select("doc_id", F.expr("substring(text, 1, 30)").alias("start"), "text", F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE '逃汇罪' END").alias("alias"))
    c = x.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("ord"), F.lit("[S1] ").alias("source"), F.concat(F.substring("start", 1, 15), F.lit("【逃汇罪】"), F.substring("start", 16, 15)).alias("quote"))
    sources = x.select(F.col("doc_id").alias("query_id"), F.lit("S1").alias("source"), F.col("doc_id").alias("chunk_id"), "text", "alias")
    return verify.check_citations(c, sources).select("query_id", "valid", "reason")


def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a list of ids."""
    q = tables.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("N"), F.col("item_id")).alias("id"), "text")
    return files.with_ids(q, "N1, N7,,N25 ,X").select("id", F.md5("text").alias("text_md5"))


def detail_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows as they are written as CSV and read again; rows without has_gold get it by type."""
    path = shared_path(spark, "details")
    x = docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 == 0, "out_of_kb").otherwise("normal").alias("type"), (F.col("doc_id") % 3 == 0).alias("refused"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id") % 8 == 1).alias("case_ok"),
        F.array("lang", "source").alias("gold"), F.split(F.substring("text", 1, 40), " ").alias("missing_points"), F.coalesce("text", F.lit("")).alias("answer"), (F.col("doc_id") / 8).alias("seconds"),
    )
    files.write_details(x, path)
    r = files.read_details(spark, path)
    return r.select("id", "type", "refused", "case_ok", "has_gold", F.array_join("gold", "|").alias("gold"), F.size("missing_points").alias("n_missing"), F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5"), "seconds")


# ---- SQL

PAGED = f"pages_ AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN CAST(floor(i / 7) AS INTEGER) + 1 END AS page, i AS line_no, {PAGE_LINE.replace('AS STRING', 'AS VARCHAR')} AS text FROM (SELECT doc_id, source, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"
JUNKED = " OR ".join(f"regexp_matches(text, {rx(p)})" for p in cleaning.LINE_RULES)
NAMED = f"regexp_replace(regexp_replace(regexp_replace({NAME}, {rx(cleaning.NAME_NUMBER)}, ''), {rx(cleaning.NAME_SITES[0])}, ''), {rx(cleaning.NAME_SITES[1])}, '')"
DATED = "CASE WHEN regexp_matches(n, '^.+?_\\d{8}$') THEN regexp_replace(regexp_extract(n, '_(\\d{8})$', 1), '(\\d{4})(\\d{2})(\\d{2})', '\\1-\\2-\\3') ELSE '' END"
TITLES_SQL = f"SELECT doc_id, CASE WHEN regexp_matches(n, '^.+?_\\d{{8}}$') THEN left(n, length(n) - 9) ELSE n END AS title, {DATED} AS date FROM (SELECT doc_id, {NAMED} AS n FROM documents)"
LEVEL = "CASE WHEN contains(x, '案例') THEN '典型案例' WHEN regexp_matches(x, '^(最高人民法院|最高人民检察院).*解释') THEN '司法解释' WHEN regexp_matches(x, '^中华人民共和国.*法$') OR regexp_matches(x, '^全国人民代表大会常务委员会.*决定$') THEN '法律' WHEN regexp_matches(x, '条例$|^国务院关于') THEN '行政法规' WHEN regexp_matches(x, '(办法|规定|细则)$') AND NOT contains(x, '通知') THEN '部门规章' ELSE '规范性文件' END"
LEVELED = "regexp_replace(regexp_replace(t, '^【.*?】', ''), '（[^）]*(修正|修订|年版|最新版)[^）]*）$', '')"
LEVELS_SQL = f"SELECT doc_id, {LEVEL} AS level, regexp_replace(regexp_replace(t, '^中华人民共和国', ''), '（.*?）$', '') AS short FROM (SELECT doc_id, t, {LEVELED} AS x FROM (SELECT doc_id, {TITLE} AS t FROM documents))"
CLEANED = f"""{PAGED}, paged AS (SELECT * FROM pages_ WHERE page IS NOT NULL), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM paged GROUP BY 1),
often AS (SELECT doc_id, text FROM (SELECT doc_id, text, count(DISTINCT page) AS w FROM paged WHERE length(text) >= 6 AND NOT regexp_matches(text, '^\\d+$') GROUP BY 1, 2) JOIN n USING (doc_id) WHERE n >= 3 AND w >= greatest(3, 0.5 * n)),
kept AS (SELECT *, text = CAST(page AS VARCHAR) AS number FROM paged p WHERE NOT ({JUNKED}) AND NOT EXISTS (FROM often o WHERE o.doc_id = p.doc_id AND o.text = p.text)),
led AS (SELECT * FROM kept QUALIFY NOT (number AND coalesce(sum(CASE WHEN number THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no), 0) = 0)),
ended AS (SELECT * FROM led QUALIFY NOT (number AND row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) = 1))"""
CLEAN_SQL = f"WITH {CLEANED} SELECT doc_id, page, line_no, md5(text) AS text_md5 FROM ended UNION ALL SELECT doc_id, page, line_no, md5(text) FROM pages_ WHERE page IS NULL"
META = f"""{PAGED}, near AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) AS r FROM pages_ WHERE page IS NOT NULL),
meta AS (SELECT doc_id, coalesce(regexp_extract(head, '(?:发布日期|发布时间|时间)[：:]\\s*(\\d{{4}})[-年/](\\d{{1,2}})[-月/](\\d{{1,2}})', ['y', 'm', 'd']), NULL) AS d, regexp_extract(head, '文\\s*号：\\s*(\\S+〔\\d{{4}}〕\\d+号)', 1) AS doc_no, regexp_extract(ends, '（(已修改|已废止|已失效|部分失效)）', 1) AS status
  FROM (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (page = 1), '') AS head, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (r <= 4), '') AS ends FROM near GROUP BY 1))"""
META_DATE = "CASE WHEN d.y <> '' THEN d.y || '-' || lpad(d.m, 2, '0') || '-' || lpad(d.d, 2, '0') ELSE '' END"
META_SQL = f"WITH {META} SELECT doc_id, {META_DATE} AS date, doc_no, status FROM meta"
OVER = "over_ AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(lit, r))})" for r in OVERRIDES) + ") o(source, doc_type, effective_date, status))"
OVERRIDE_SQL = f"""WITH {META}, {OVER}, x AS (SELECT doc_id, source, {TITLE} AS t, {NAMED} AS n FROM documents), y AS (SELECT *, {LEVELED} AS x FROM x)
SELECT doc_id, coalesce(nullif(o.doc_type, ''), {LEVEL.replace("(x,", "(y.x,")}) AS doc_type, coalesce(nullif({DATED}, ''), nullif({META_DATE}, ''), nullif(o.effective_date, ''), '') AS effective_date, coalesce(nullif(m.status, ''), nullif(o.status, ''), '') AS status
FROM y LEFT JOIN meta m USING (doc_id) LEFT JOIN over_ o USING (source)"""
SUFFIX = f"lower(regexp_extract({PATH}, '(\\.[^./]*)$', 1))"
ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(a)}, {lit(n)})" for a, n in rules.OFFENCES) + ") a(article, alias))"
PINNED_SQL = f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, {ASKS} AS text FROM conversations WHERE role = 'user'), n AS (SELECT DISTINCT query_id, text, unnest(regexp_extract_all(text, '第[{enrich.NUMERAL}]+条(?:之[一二三四五六七八九十]+)?')) AS article FROM q),
c AS (SELECT doc_id AS chunk_id, CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '刑法' END AS short, concat('第', {num('doc_id % 16 + 1')}, '条', CASE WHEN doc_id % 5 = 0 THEN '之一' ELSE '' END) AS article FROM documents)
SELECT DISTINCT query_id, chunk_id FROM n JOIN c USING (article) WHERE contains(text, short)"""
EMBED_SQL = "SELECT doc_id, md5(concat_ws(' ', '《' || source || '》', CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END, CASE WHEN doc_id % 3 = 0 THEN '节' END, CASE WHEN doc_id % 5 = 0 THEN '【x】' END) || chr(10) || coalesce(text, '')) AS text_md5 FROM documents"
INDEX_SQL = f"""WITH e AS (SELECT *, '《' || source || '》' || chr(10) || coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '{index.SPARSE_WORD}')) AS token FROM e),
k AS (SELECT doc_id, count(DISTINCT token) AS n_tokens, count(*) AS weight, max(token) AS last FROM w GROUP BY 1)
SELECT CAST(e.doc_id AS VARCHAR) AS chunk_id, source AS doc_title, CAST(n_chars AS INTEGER) AS article_no, CASE WHEN e.doc_id % 2 = 0 THEN 3 END AS page_start, lang = 'fr' AS is_case, length(t) - 1 AS pairs, n_tokens, weight, last FROM e LEFT JOIN k USING (doc_id)"""
ROUND_SQL = f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS doc_id, CASE WHEN lang = 'fr' THEN '{retrieve.CASE_TYPE}' ELSE '法律' END AS doc_type, CAST(n_chars AS INTEGER) AS article_no, CASE WHEN doc_id % 2 = 0 THEN 3 END AS page_start, md5(coalesce(text, '')) AS text_md5 FROM documents"
ISSUES_SQL = f"""WITH p AS (SELECT item_id AS query_id, list_filter(string_split_regex(text, '\\. ?'), lambda t: t <> '')[1:{answer.ISSUES}] AS q FROM benchmark WHERE item_id % 5 <> 3)
SELECT query_id, search_no, md5(t) AS text_md5 FROM (SELECT query_id, unnest(q) AS t, unnest(range(1, len(q) + 1))::INTEGER AS search_no FROM p)"""
REFUSE_SQL = f"""SELECT item_id, item_id % 4 IN (0, 2) AS refused, CASE item_id % 4 WHEN 0 THEN '{answer.NO_EVIDENCE}' WHEN 2 THEN '{answer.CITATION_FAILED}' ELSE '' END AS refuse_reason,
CASE WHEN item_id % 4 IN (0, 2) THEN '{answer.REFUSAL}' ELSE 'an answer' END AS final, CASE WHEN item_id % 4 IN (0, 2) THEN '' ELSE 'yes' END AS verdict FROM benchmark"""
_norm = "translate(regexp_replace({x}, '[\\s　]+', '', 'g'), " + lit(fn.UNIFY_FROM) + ", " + lit(fn.UNIFY_TO) + ")"
ALIAS_SQL = f"""WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 15) || '【逃汇罪】' || substring(text, 16, 15) ELSE substring(text, 1, 30) END AS quote FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, {_norm.format(x="text")} AS body, list_filter(list_transform(string_split_regex(quote, '……|\\.\\.\\.|…'), lambda f: trim(trim({_norm.format(x="f")}, {lit(fn.EDGE_MARKS)}), '"''')), lambda f: f <> '') AS f FROM q),
r AS (SELECT doc_id, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) >= {fn.LEAST_QUOTE} AND list_reduce(list_transform(f, lambda x: {{'at': CAST(0 AS BIGINT), 'f': x}}), lambda z, x: {{'at': CASE WHEN z.at < 0 OR strpos(substring(body, z.at + 1), x.f) = 0 THEN -1 ELSE z.at + strpos(substring(body, z.at + 1), x.f) + length(x.f) - 1 END, 'f': ''}}, {{'at': CAST(0 AS BIGINT), 'f': ''}}).at >= 0 AS valid FROM p)
SELECT doc_id AS query_id, coalesce(valid, false) AS valid, CASE WHEN coalesce(valid, false) THEN '' ELSE '{verify.NOT_VERBATIM}' END AS reason FROM r"""
IDS_SQL = "SELECT 'N' || item_id AS id, md5(text) AS text_md5 FROM benchmark WHERE item_id IN (1, 7, 25)"
DETAIL_SQL = """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN 'out_of_kb' ELSE 'normal' END AS type, doc_id % 3 = 0 AS refused, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 8 = 1 END AS case_ok, doc_id % 5 <> 0 AS has_gold,
lang || '|' || source AS gold, coalesce(len(string_split(substring(text, 1, 40), ' ')), 0) AS n_missing, md5(coalesce(text, '')) AS answer_md5, doc_id / 8 AS seconds FROM documents"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {
        f.__name__: f
        for f in (
            file_titles, authority_levels, clean_pages, page_metadata, metadata_overrides, chinese_numbers, prefer_files, offence_alias, pinned_articles, embedding_texts, index_roundtrip, chunk_roundtrip, stored_cases, plan_issues, refusals, alias_quotes,
            question_ids, detail_roundtrip,
        )
    }


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "file_titles": TITLES_SQL, "authority_levels": LEVELS_SQL, "clean_pages": CLEAN_SQL, "page_metadata": META_SQL, "metadata_overrides": OVERRIDE_SQL,
        "chinese_numbers": f"SELECT doc_id, {sql_number('x')} AS value FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 500 AS VARCHAR) ELSE {num('doc_id % 199 + 1')} END AS x FROM documents)",
        "prefer_files": f"SELECT doc_id, CASE {SUFFIX} WHEN '.docx' THEN 0 WHEN '.doc' THEN 1 WHEN '.md' THEN 1 WHEN '.pdf' THEN 2 ELSE 3 END AS suffix_rank, length(list_extract(string_split({PATH}, '/'), -1)) AS name_length FROM documents",
        "offence_alias": f"WITH {ALIASES}, x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{rules.CRIMINAL_LAW}' ELSE '别的法' END AS doc_title, concat('第', {num('doc_id % 199 + 1')}, '条') AS article FROM documents) SELECT doc_id, doc_title, article, CASE WHEN doc_title = '{rules.CRIMINAL_LAW}' THEN coalesce(alias, '') ELSE '' END AS alias FROM x LEFT JOIN aliases USING (article)",
        "pinned_articles": PINNED_SQL, "embedding_texts": EMBED_SQL, "index_roundtrip": INDEX_SQL, "chunk_roundtrip": ROUND_SQL, "stored_cases": "SELECT doc_id || '#1' AS case_id, '案例1 甲' AS title, source, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL", "plan_issues": ISSUES_SQL, "refusals": REFUSE_SQL, "alias_quotes": ALIAS_SQL, "question_ids": IDS_SQL, "detail_roundtrip": DETAIL_SQL,
    }
