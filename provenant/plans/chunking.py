"""Queries of the chunker over the test tables, and their DuckDB SQL.

The test documents have no legal structure, so their lines are given one: by a document's number its lines become articles, outlines,
questions, cases or pages. The rule that does this is one SQL expression, which both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import segment as s

from . import tables


def numeral(n: int) -> str:
    """1 to 999 in Chinese."""
    digits = "零一二三四五六七八九"
    hundreds, tens, ones = n // 100, n // 10 % 10, n % 10
    out = f"{digits[hundreds]}百" if hundreds else ""
    if tens:
        out += ("" if tens == 1 and not hundreds else digits[tens]) + "十"
    elif hundreds and ones:
        out += "零"
    return out + (digits[ones] if ones else "")


NUMERALS = ",".join(numeral(n) for n in range(1, 200))
num = lambda n: f"split_part('{NUMERALS}', ',', CAST(floor({n}) AS INT))"

#: A line by its document's kind k, its number i from 0, and its text t.
LINE = f"""CASE
WHEN k = 0 THEN CASE
  WHEN doc_id % 12 = 0 AND i = 0 THEN '目　录' WHEN doc_id % 12 = 0 AND i = 1 THEN '第一章 总 则' WHEN i = 160 THEN '附件1'
  WHEN i % 11 = 3 THEN concat('第', {num('i / 11 + 1')}, '章 总则')
  WHEN i % 11 = 7 THEN concat('第', {num('i / 11 + 1')}, '节')
  WHEN i % 11 = 8 THEN substring(t, 1, 10 + i % 40)
  WHEN i % 14 = 12 THEN concat('第', {num('i / 2')}, '条之一 ', t)
  WHEN i % 34 = 20 THEN concat('第', {num('i / 2')}, '条')
  WHEN i % 2 = 0 THEN concat('第', {num('i / 2 + 1 + CASE WHEN i % 10 = 4 THEN 5 ELSE 0 END')}, '条 ', t) ELSE t END
WHEN k = 1 THEN CASE
  WHEN i % 6 = 2 THEN concat({num('i / 6 + 1 + CASE WHEN i % 24 = 8 THEN 2 ELSE 0 END')}, '、', t)
  WHEN i % 6 = 3 AND i % 24 = 9 THEN concat({num('i / 6 + 1')}, '、', t)
  WHEN i % 6 > 3 THEN concat('（', {num('i % 6 - 3')}, '）', t) ELSE t END
WHEN k = 2 THEN CASE WHEN i % 4 = 1 THEN concat(CAST(CAST(floor(i / 4) AS INT) + 1 AS STRING), '、', t) WHEN i % 4 = 3 THEN concat(CAST(i % 7 AS STRING), '.', t) ELSE t END
WHEN k = 3 THEN CASE
  WHEN i = 0 THEN '案例二：补充的标题' WHEN i % 13 = 1 THEN concat('案例', {num('i / 13 + 1')}, CASE WHEN i % 2 = 0 THEN concat('：', substring(t, 1, 20)) ELSE '' END)
  WHEN i % 13 = 3 THEN '【基本案情】' WHEN i % 13 = 6 THEN concat('二、 典型意义', substring(t, 1, 12)) WHEN i % 13 = 9 THEN substring(t, 1, 30 + i % 17) WHEN i % 13 = 10 THEN concat('【关键词】', t) ELSE t END
ELSE t END"""
PAGE = "CASE WHEN k = 4 THEN CAST(floor(i / 4) AS INT) + 1 WHEN k IN (0, 3) AND floor(doc_id / 6) % 2 = 0 THEN CAST(floor(i / 9) AS INT) + 1 END"
TYPE = "CASE WHEN k = 3 THEN '典型案例' WHEN k = 2 THEN '权威解读' WHEN k = 5 THEN '部门规章' WHEN k = 0 THEN '法律' ELSE '规范性文件' END"


def regulations(spark: SparkSession, sf_dir: str, *kinds: int) -> DataFrame:
    """(doc_id, doc_title, doc_type, lines) of documents of some kinds."""
    d = tables.table(spark, sf_dir, "documents").withColumn("k", F.expr("doc_id % 6")).where(F.col("k").isin(*kinds))
    x = d.select("doc_id", "k", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    x = x.select("doc_id", "k", "source", "i", F.expr(LINE).alias("text"), F.expr(PAGE).alias("page")).where("text <> ''")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "text", "page"))), lambda z: F.struct(z["text"].alias("text"), z["page"].alias("page")))
    x = x.groupBy("doc_id", "k", "source").agg(rows.alias("lines"))
    return x.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.col("source"), F.lit("条例")).alias("doc_title"), F.expr(TYPE).alias("doc_type"), "lines")


def shown(x: DataFrame) -> DataFrame:
    """What is compared of chunks."""
    return x.select("chunk_id", "kind", "chapter", "section", "article_no", "page_start", "page_end", F.md5("text").alias("text_md5"), "citation")


def of_layout(spark: SparkSession, sf_dir: str, name: str, *kinds: int) -> DataFrame:
    """Chunks of the documents that have a layout."""
    docs = regulations(spark, sf_dir, *kinds).where(s.layout(F.col("doc_type"), F.col("lines")) == name)
    return shown(s.chunks(docs, s.LAYOUTS[name](docs.select("doc_id", "lines"))))


def chunk_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way each document is cut."""
    return regulations(spark, sf_dir, 0, 1, 2, 3, 4, 5).select("doc_id", s.layout(F.col("doc_type"), F.col("lines")).alias("layout"))


def chunk_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws by article."""
    return of_layout(spark, sf_dir, "articles", 0)


def chunk_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is odd about laws: gaps between articles, contents that don't end, no chunks."""
    return s.warnings(regulations(spark, sf_dir, 0).where(s.layout(F.col("doc_type"), F.col("lines")) == "articles"))


def chunk_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered outlines by item."""
    return of_layout(spark, sf_dir, "outline", 1)


def chunk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions, by question."""
    return of_layout(spark, sf_dir, "questions", 2)


def chunk_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by their parts."""
    return of_layout(spark, sf_dir, "cases", 3)


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other documents by page."""
    return of_layout(spark, sf_dir, "pages", 4, 5)


def chunk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents."""
    return of_layout(spark, sf_dir, "whole", 0, 1, 2, 4, 5)


# ---- SQL


def rx(pattern: str) -> str:
    """A pattern as RE2 reads it."""
    return "$rx$" + pattern.replace(r"\s*", r"[\s　]*") + "$rx$"


def sql_number(text: str) -> str:
    """Value of a numeral, by its hundreds, tens and ones."""
    digit = lambda x: f"coalesce(nullif(strpos('一二三四五六七八九', right({x}, 1)), 0), 1)"
    part = lambda unit, n: f"CASE WHEN contains(x, '{unit}') THEN {n} * (CASE WHEN regexp_matches(x, '[一二三四五六七八九]{unit}') THEN strpos('一二三四五六七八九', regexp_extract(x, '([一二三四五六七八九]){unit}', 1)) ELSE 1 END) ELSE 0 END"
    ones = "CASE WHEN regexp_matches(x, '[一二三四五六七八九]$') THEN strpos('一二三四五六七八九', right(x, 1)) ELSE 0 END"
    body = f"{part('千', 1000)} + {part('百', 100)} + {part('十', 10)} + {ones}".replace("x,", f"{text},").replace("right(x", f"right({text}").replace("contains(x", f"contains({text}")
    return f"(CASE WHEN regexp_matches({text}, '^[0-9]+$') THEN CAST({text} AS INTEGER) ELSE {body} END)"


def sql_packed(sizes: str, limit: int) -> str:
    """Numbers of the packs that greedy filling puts sizes in."""
    state = f"list_transform({sizes}, lambda n: {{'p': -1, 'room': CAST(n AS INTEGER), 'got': CAST([] AS INTEGER[])}})"
    opens = "(z.p < 0 OR x.room > z.room)"
    step = f"""{{'p': CASE WHEN {opens} THEN z.p + 1 ELSE z.p END, 'room': CASE WHEN {opens} THEN {limit} ELSE z.room END - x.room, 'got': list_append(z.got, CASE WHEN {opens} THEN z.p + 1 ELSE z.p END)}}"""
    return f"list_reduce({state}, lambda z, x: {step}, {{'p': -1, 'room': 0, 'got': CAST([] AS INTEGER[])}}).got"


def sql_packs(source: str, limit: int) -> str:
    """CTE ``packs``: doc_id, sec, k, o (order within), text, page from rows (doc_id, sec, g, pos, text, page)."""
    return f"""pg AS (SELECT doc_id, sec, g, min(pos) AS gp, list(length(text) ORDER BY pos) AS sizes, list(pos ORDER BY pos) AS ps FROM {source} GROUP BY ALL),
pu AS (SELECT doc_id, sec, gp, unnest(ps) AS pos, unnest(sizes) AS size, unnest(CASE WHEN list_sum(sizes) <= {limit} THEN list_transform(sizes, lambda z: 0) ELSE {sql_packed('sizes', limit)} END) AS part FROM pg),
pv AS (SELECT doc_id, sec, list(gp ORDER BY gp, part) AS gps, list(part ORDER BY gp, part) AS parts, list(size ORDER BY gp, part) AS units FROM (SELECT doc_id, sec, gp, part, sum(size)::INTEGER AS size FROM pu GROUP BY ALL) GROUP BY ALL),
pw AS (SELECT doc_id, sec, unnest(gps) AS gp, unnest(parts) AS part, unnest({sql_packed('units', limit)}) AS k FROM pv),
packs AS (SELECT doc_id, sec, k, row_number() OVER (PARTITION BY doc_id, sec, k ORDER BY gp, part, pos) AS o, r.text, r.page, pos FROM pu JOIN pw USING (doc_id, sec, gp, part) JOIN {source} r USING (doc_id, sec, pos))"""


def sql_lines(*kinds: int) -> str:
    """CTEs ``docs`` and ``ls``: documents with type, title and layout, and their lines."""
    count = lambda p: f"count_if(regexp_matches(text, {rx(p)}))"
    return f"""raw AS (SELECT doc_id, doc_id % 6 AS k, source, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) WHERE doc_id % 6 IN ({", ".join(map(str, kinds))})),
every AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (SELECT doc_id, k, source, i, {LINE.replace("AS STRING", "AS VARCHAR")} AS text, {PAGE} AS page FROM raw) WHERE text <> ''),
docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source || '条例' AS doc_title, doc_type, CASE WHEN doc_type <> '{s.CASE_TYPE}' AND a < {s.ARTICLES} AND size <= {s.PACK} THEN 'whole' WHEN doc_type = '{s.CASE_TYPE}' THEN 'cases'
  WHEN a >= {s.ARTICLES} THEN 'articles' WHEN b >= {s.ITEMS} THEN 'outline' WHEN c >= {s.QUESTIONS} THEN 'questions' ELSE 'pages' END AS layout
  FROM (SELECT doc_id, source, {TYPE} AS doc_type, {count(s.ARTICLE)} AS a, {count(s.ITEM)} AS b, {count(s.QUESTION)} AS c, sum(length(text)) AS size FROM every GROUP BY doc_id, source, k)),
ls AS (SELECT e.* REPLACE (CAST(e.doc_id AS VARCHAR) AS doc_id), layout FROM every e JOIN docs d ON d.doc_id = CAST(e.doc_id AS VARCHAR))"""


#: From ``made`` (doc_id, ix, kind, label, no, chapter, section, lead, least, first_page) and ``held`` (doc_id, ix, o, text, page).
TAIL = f"""hs AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id, ix ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM held),
bodies AS (SELECT doc_id, ix, string_agg(CASE WHEN coalesce(before, 0) = 0 THEN '' WHEN coalesce(page, 0) = 0 OR regexp_matches(text, {rx(s.SUBITEM)}) OR regexp_matches(text, {rx(s.KEEPS_BREAK)}) THEN chr(10) ELSE '' END || text, '' ORDER BY o) AS body,
  arg_min(coalesce(page, 0), o) AS a, arg_max(coalesce(page, 0), o) AS b FROM hs GROUP BY ALL),
full_ AS (SELECT m.*, CASE WHEN kind = 'article' THEN trim(lead || body, ' ') ELSE lead || body END AS text, coalesce(first_page, nullif(a, 0)) AS page_start, nullif(b, 0) AS page_end FROM made m JOIN bodies USING (doc_id, ix)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY ix) AS n FROM full_ WHERE length(text) >= least)
SELECT n.doc_id || '#' || label || CASE WHEN n > 1 THEN '(' || n || ')' ELSE '' END AS chunk_id, kind, chapter, section, no::INTEGER AS article_no, page_start, page_end, md5(text) AS text_md5,
  concat_ws(' ', '《' || doc_title || '》', nullif(chapter, ''), nullif(section, ''), nullif(label, ''), CASE WHEN page_start = page_end THEN '第' || page_start || '页' WHEN page_start IS NOT NULL THEN '第' || page_start || '-' || coalesce(CAST(page_end AS VARCHAR), '') || '页' END) AS citation
FROM numbered n JOIN docs USING (doc_id)"""
PLAIN = "'' AS chapter, '' AS section"

LAYOUT = f"WITH {sql_lines(0, 1, 2, 3, 4, 5)} SELECT doc_id, layout FROM docs"


def sql_outline(kind: int, layout: str, item: str, unit: str) -> str:
    """Items in the order of their numbers; what stands before the first is the preface."""
    return f"""WITH RECURSIVE {sql_lines(kind)}, own AS MATERIALIZED (SELECT * FROM ls WHERE layout = '{layout}'),
cand AS MATERIALIZED (SELECT doc_id, pos, {sql_number(f"regexp_extract(text, {rx(item)}, 1)")} AS no FROM own WHERE regexp_matches(text, {rx(item)})),
acc AS (SELECT doc_id, 0 AS no, CAST(-1 AS BIGINT) AS pos FROM docs UNION ALL SELECT * FROM (SELECT a.doc_id, a.no + 1 AS no, (SELECT min(c.pos) FROM cand c WHERE c.doc_id = a.doc_id AND c.no = a.no + 1 AND c.pos > a.pos) AS pos FROM acc a) WHERE pos IS NOT NULL),
sec AS (SELECT o.doc_id, o.pos, o.text, o.page, max(a.no) AS sec FROM own o JOIN acc a ON a.doc_id = o.doc_id AND a.pos <= o.pos GROUP BY ALL),
rows_ AS (SELECT *, CASE WHEN sec = 0 THEN 0 ELSE sum(CASE WHEN regexp_matches(text, {rx(s.SUBITEM)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY pos) END AS g FROM sec),
items AS (SELECT * FROM rows_ WHERE sec > 0), {sql_packs("items", s.PACK)},
heads AS (SELECT doc_id, sec, arg_min(text, pos) AS opening FROM items GROUP BY ALL), counts AS (SELECT doc_id, sec, max(k) AS most FROM packs GROUP BY ALL),
made AS (SELECT doc_id, sec * 100000 + k AS ix, 'outline' AS kind, '第' || regexp_extract(opening, {rx(item)}, 1) || '{unit}' || CASE WHEN most > 0 THEN '-' || (k + 1) ELSE '' END AS label, sec AS no, {PLAIN},
    CASE WHEN k > 0 THEN '（接第' || regexp_extract(opening, {rx(item)}, 1) || '{unit}：' || substring(opening, 1, {s.OPENING}) || '……）' || chr(10) ELSE '' END AS lead, 1 AS least, NULL::INTEGER AS first_page
    FROM (SELECT DISTINCT doc_id, sec, k FROM packs) JOIN heads USING (doc_id, sec) JOIN counts USING (doc_id, sec)
  UNION ALL SELECT DISTINCT doc_id, -1, 'preamble', '前言', 0, {PLAIN}, '', {s.LEAST_PREFACE}, NULL FROM rows_ WHERE sec = 0),
held AS (SELECT doc_id, sec * 100000 + k AS ix, o, text, page FROM packs UNION ALL SELECT doc_id, -1, pos, text, page FROM rows_ WHERE sec = 0), {TAIL}"""


CASE_SQL = f"""WITH {sql_lines(3)}, own AS (SELECT *, regexp_matches(text, {rx(s.CASE)}) AS numbered, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS below FROM ls WHERE layout = 'cases'),
marked AS (SELECT *, NOT numbered AND coalesce(starts_with(below, '{s.KEYWORDS}'), false) AND length(text) <= {s.CASE_TITLE} AND NOT starts_with(text, '【') AS bare FROM own),
cut AS (SELECT *, sum(CASE WHEN numbered OR bare THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec, sum(CASE WHEN bare THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM marked),
starts AS (SELECT doc_id, sec, page, CASE WHEN numbered THEN {sql_number(f"regexp_extract(text, {rx(s.CASE)}, 1)")} ELSE nth END AS no, CASE WHEN numbered THEN trim(regexp_extract(text, {rx(s.CASE)}, 2), ' ') ELSE text END AS title FROM cut WHERE numbered OR bare),
known AS (SELECT doc_id, no, arg_max(title, sec) AS other FROM starts WHERE title <> '' GROUP BY ALL),
named AS (SELECT s.*, trim('案例' || s.no || ' ' || CASE WHEN title <> '' THEN title ELSE coalesce(other, '') END, ' ') AS name FROM starts s LEFT JOIN known USING (doc_id, no)),
sized AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id, sec) AS size, sum(CASE WHEN regexp_matches(text, {rx(s.CASE_PART)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY pos) AS g FROM cut WHERE sec > 0 AND NOT numbered AND NOT bare),
items AS (SELECT doc_id, sec, g, pos, text, page FROM sized WHERE size >= {s.LEAST_CASE}), {sql_packs("items", s.PACK)},
parts AS (SELECT doc_id, sec, k, string_agg(part, '、' ORDER BY o) AS part FROM (SELECT doc_id, sec, k, part, min(o) AS o FROM (SELECT *, left(list_extract(string_split(trim(text, '【】'), '、'), -1), 8) AS part FROM packs WHERE regexp_matches(text, {rx(s.CASE_PART)})) GROUP BY ALL) GROUP BY ALL),
made AS (SELECT doc_id, sec * 100000 + k AS ix, 'case' AS kind, name || '·' || coalesce(nullif(part, ''), '正文') AS label, no, {PLAIN}, name || '｜' || coalesce(nullif(part, ''), '正文') || chr(10) AS lead, 1 AS least, CASE WHEN k = 0 THEN coalesce(page, 0) END AS first_page
    FROM (SELECT DISTINCT doc_id, sec, k FROM packs) JOIN named USING (doc_id, sec) LEFT JOIN parts USING (doc_id, sec, k)
  UNION ALL SELECT DISTINCT doc_id, -1, 'preamble', '说明', 0, {PLAIN}, '', {s.LEAST_CASE}, NULL FROM cut WHERE sec = 0),
held AS (SELECT doc_id, sec * 100000 + k AS ix, o, text, page FROM packs UNION ALL SELECT doc_id, -1, pos, text, page FROM cut WHERE sec = 0), {TAIL}""".replace("coalesce(first_page, nullif(a, 0)) AS page_start", "CASE WHEN first_page IS NOT NULL THEN nullif(first_page, 0) ELSE nullif(a, 0) END AS page_start")
PAGES_SQL = f"""WITH {sql_lines(4, 5)}, items AS (SELECT doc_id, 0 AS sec, coalesce(page, -1) AS g, pos, text, page FROM ls WHERE layout = 'pages'), {sql_packs("items", s.PAGE_PACK)},
made AS (SELECT doc_id, k AS ix, 'page' AS kind, CASE WHEN coalesce(arg_min(coalesce(page, 0), o), 0) > 0 THEN '第' || arg_min(coalesce(page, 0), o) || '页' ELSE '第' || (k + 1) || '段' END AS label, k + 1 AS no, {PLAIN}, '' AS lead, 1 AS least, NULL::INTEGER AS first_page FROM packs GROUP BY doc_id, k),
held AS (SELECT doc_id, k AS ix, o, text, page FROM packs), {TAIL}"""
WHOLE_SQL = f"""WITH {sql_lines(0, 1, 2, 4, 5)}, made AS (SELECT doc_id, 0 AS ix, 'page' AS kind, '全文' AS label, 1 AS no, {PLAIN}, '' AS lead, 1 AS least, NULL::INTEGER AS first_page FROM docs WHERE layout = 'whole'),
held AS (SELECT doc_id, 0 AS ix, pos AS o, text, page FROM ls WHERE layout = 'whole'), {TAIL}"""

_squashed = lambda x: f"regexp_replace({x}, '[\\s　]+', '', 'g')"
_kind = "CASE " + " ".join(f"WHEN regexp_matches(text, {rx(p)}) THEN '{k}'" for k, p in s.HEADINGS.items()) + " ELSE '' END"
_pick = lambda n: "CASE " + " ".join(f"WHEN regexp_matches(text, {rx(p)}) THEN regexp_extract(text, {rx(p)}, {n})" for p in s.HEADINGS.values()) + " END"
#: One step a line: what is open before it decides what it is.
ARTICLE_STEPS = f"""{sql_lines(0)}, own AS (SELECT doc_id, pos, text, page, {_squashed("text")} AS squashed, regexp_matches(text, {rx(s.CONTENTS)}) AS contents, regexp_matches(text, {rx(s.APPENDIX)}) AS appendix, {_kind} AS kind,
    coalesce('第' || {_pick(1)} || {_kind}, '') AS heading, coalesce({_squashed(_pick(2))}, '') AS named, regexp_matches(text, {rx(s.ARTICLE)}) AS is_article, regexp_extract(text, {rx(s.ARTICLE)}, 1) AS n1, regexp_extract(text, {rx(s.ARTICLE)}, 2) AS n2, regexp_extract(text, {rx(s.ARTICLE)}, 3) AS rest
  FROM ls WHERE layout = 'articles'),
told AS MATERIALIZED (SELECT *, CASE WHEN is_article THEN {sql_number("n1")} ELSE 0 END AS no, CASE WHEN n2 <> '' THEN {sql_number("substring(n2, 2)")} ELSE 0 END AS sub, lead(text) OVER w AS below, lead(squashed) OVER w AS below_squashed, lead(kind) OVER w AS below_kind, lead(is_article) OVER w AS below_article FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
what AS MATERIALIZED (SELECT *, kind <> '' AND length(text) <= {s.HEADING_LENGTH} AND NOT appendix AS is_heading, kind <> '' AND length(text) <= {s.HEADING_LENGTH} AND NOT appendix AND named = '' AND below IS NOT NULL AND length(below) <= {s.HEADING_REST} AND below_kind = '' AND NOT below_article AS joins FROM told),
steps AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, false AS inside, '' AS first, false AS skip, false AS stopped, 0 AS last_no, 0 AS last_sub, 0 AS open_no, 0 AS open_sub, true AS opened, CAST(0 AS BIGINT) AS seq, '题注' AS label, '' AS part, '' AS chapter, '' AS section, NULL::VARCHAR AS gives, NULL::INTEGER AS page, NULL::VARCHAR AS warning
    FROM docs WHERE layout = 'articles'
  UNION ALL SELECT doc_id, pos, inside_, first_, skip_, stopped OR stops, CASE WHEN takes THEN no ELSE last_no END, CASE WHEN takes THEN sub ELSE last_sub END, CASE WHEN takes THEN no ELSE open_no END, CASE WHEN takes THEN sub ELSE open_sub END,
    CASE WHEN heads THEN false WHEN takes THEN true ELSE opened END, CASE WHEN heads OR takes THEN seq + 1 ELSE seq END, CASE WHEN takes THEN '第' || n1 || '条' || n2 ELSE label END,
    CASE WHEN heads AND kind = '编' THEN name ELSE part END, CASE WHEN heads AND kind = '章' THEN name WHEN heads AND kind = '编' THEN '' ELSE chapter END, CASE WHEN heads AND kind = '节' THEN name WHEN heads THEN '' ELSE section END,
    CASE WHEN NOT line OR stops THEN NULL WHEN takes OR same THEN nullif(rest, '') WHEN opened THEN text END, page_, CASE WHEN takes AND sub = 0 AND no <> last_no + 1 THEN 'article ' || no || ' follows ' || last_no END
  FROM (SELECT *, line AND NOT stops AND is_article AND NOT same AND (no, sub) > (last_no, last_sub) AND no <= last_no + {s.GAP} AS takes FROM
    (SELECT *, line AND last_no > 0 AND appendix AS stops, line AND is_article AND opened AND open_no > 0 AND no = open_no AND sub = open_sub AS same FROM
    (SELECT *, seen AND is_heading AS heads, seen AND NOT is_heading AS line, seen AND joins AS skip_, heading || CASE WHEN named <> '' THEN ' ' || named WHEN joins THEN ' ' || below_squashed ELSE '' END AS name FROM
    (SELECT s.* EXCLUDE (pos, page), w.pos, w.page AS page_, w.* EXCLUDE (doc_id, pos, page), CASE WHEN s.skip OR s.stopped THEN s.inside WHEN w.contents THEN true WHEN s.inside AND w.kind IN ('编', '章') AND s.first = w.squashed THEN false ELSE s.inside END AS inside_,
      CASE WHEN s.skip OR s.stopped OR w.contents THEN s.first WHEN s.inside AND w.kind IN ('编', '章') AND s.first = '' THEN w.squashed ELSE s.first END AS first_,
      NOT s.skip AND NOT s.stopped AND NOT w.contents AND (NOT s.inside OR (w.kind IN ('编', '章') AND s.first = w.squashed)) AS seen
      FROM steps s JOIN what w ON w.doc_id = s.doc_id AND w.pos = s.pos + 1)))))"""
ARTICLE_SQL = f"""WITH RECURSIVE {ARTICLE_STEPS},
held AS (SELECT doc_id, seq AS ix, pos AS o, gives AS text, page FROM steps WHERE gives IS NOT NULL),
made AS (SELECT DISTINCT doc_id, seq AS ix, CASE WHEN open_no = 0 THEN 'preamble' ELSE 'article' END AS kind, label, open_no AS no, concat_ws(' ', nullif(part, ''), nullif(chapter, '')) AS chapter, section, CASE WHEN open_no = 0 THEN '' ELSE label || ' ' END AS lead, CASE WHEN open_no = 0 THEN {s.LEAST_PREFACE} ELSE 1 END AS least, NULL::INTEGER AS first_page
  FROM steps WHERE gives IS NOT NULL), {TAIL}"""
WARNINGS_SQL = f"""WITH RECURSIVE {ARTICLE_STEPS}, good AS (SELECT DISTINCT doc_id FROM steps WHERE gives IS NOT NULL AND open_no > 0 UNION SELECT doc_id FROM steps WHERE gives IS NOT NULL AND open_no = 0 GROUP BY doc_id HAVING sum(length(gives)) >= {s.LEAST_PREFACE})
SELECT doc_id, warning FROM steps WHERE warning IS NOT NULL UNION ALL SELECT doc_id, 'the table of contents doesn''t end' FROM (SELECT doc_id, arg_max(inside, pos) AS inside, arg_max(stopped, pos) AS stopped FROM steps GROUP BY 1) WHERE inside AND NOT stopped
UNION ALL SELECT doc_id, 'no chunks' FROM docs WHERE layout = 'articles' AND doc_id NOT IN (SELECT doc_id FROM good)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    return {f.__name__: f for f in (chunk_layouts, chunk_articles, chunk_warnings, chunk_outlines, chunk_questions, chunk_cases, chunk_pages, chunk_whole)}


def oracle_sql() -> dict[str, str]:
    """By name."""
    return {
        "chunk_layouts": LAYOUT, "chunk_articles": ARTICLE_SQL, "chunk_warnings": WARNINGS_SQL, "chunk_outlines": sql_outline(1, "outline", s.ITEM, "项"), "chunk_questions": sql_outline(2, "questions", s.QUESTION, "问"),
        "chunk_cases": CASE_SQL, "chunk_pages": PAGES_SQL, "chunk_whole": WHOLE_SQL,
    }
