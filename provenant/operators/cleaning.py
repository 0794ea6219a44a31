"""Cleaning of lines and reading of metadata from names, first pages and last lines.

Tables of lines have doc_id, page (null where a format has none), line_no (within the document, in reading order) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of names, metadata and lines without content.
NAME_NUMBER = r"^\d+\."
NAME_SITES = (
    r"_(国务院文件|行政规范性文件|跨境债权债务|基本法规)?_?(中国政府网|国家外汇管理局门户网站|中华人民共和国最高人民检察院)$",
    r"-陕西法院网$",
)
NAME_DATE = r"^(.+?)_(\d{8})$"
JUNK = (
    r"^(首\s*页|主页\s*>.*|当前位置.*|简体中文|繁体中文|English|微信|微博|无障碍.*|政策法规|打印|关闭|"
    r"字号.*|【字号.*|.*本站已支持IPv6.*|请输入关键字|网上接待|新闻发布会|走进皖检|检察要闻|检务公开|检察业务|"
    r"队伍建设|科技强检|检察专题|[｜|]|提交|手机版|简|繁|网站无.*|欢迎来到.*|本院概况|雁检快讯|通知公告|刑事检察|"
    r"最高检新闻|地方动态|直播访谈|图片|专题|法律规章|权威发布|陕西法院|新闻中心|案件快报|法院建设|法官论坛|法院文化|"
    r"裁判文书|审务公开|司法为民|网站公告|专题报道|网上直播|法苑微视界|财务管理|地方联播|索\s*引\s*号.*|分\s*类：.*|"
    r"来\s*源：.*|名\s*称：.*)$"
)
URL = r"^(https?://)?[\w.-]+\.(gov|com|org|net)\.cn/\S*$|^https?://\S+$"
PRINT_TIME = r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}$"
PAGE_NUMBER = r"^([-—–一]\s*\d+\s*[-—–一]|\d+\s*/\s*\d+|第\s*\d+\s*页(\s*共\s*\d+\s*页)?)$"
DATE = r"(?:发布日期|发布时间|时间)[：:]\s*(\d{4})[-年/](\d{1,2})[-月/](\d{1,2})"
NUMBER = r"文\s*号：\s*(\S+〔\d{4}〕\d+号)"
STATUS = r"（(已修改|已废止|已失效|部分失效)）"
DATABASE_TAIL = r"(法宝联想：.*|修订沿革|相关法规.*篇.*)$"
LINE_RULES = (JUNK, URL, PAGE_NUMBER, PRINT_TIME, "^" + DATE)
LEAST_PAGES, LEAST_LENGTH, SHARE = 3, 6, 0.5
STATUS_LINES = 4

# Levels of authority, the first rule that holds deciding.
LEVEL_DROPS = (r"^【.*?】", r"（[^）]*(修正|修订|年版|最新版)[^）]*）$")
LEVELS = (
    (r"案例", "典型案例"),
    (r"^(最高人民法院|最高人民检察院).*解释", "司法解释"),
    (r"^中华人民共和国.*法$", "法律"),
    (r"^全国人民代表大会常务委员会.*决定$", "法律"),
    (r"条例$|^国务院关于", "行政法规"),
    (r"^(?!.*通知).*(办法|规定|细则)$", "部门规章"),
)
LEVEL_ELSE = "规范性文件"


def dashed(date: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD."""
    return F.regexp_replace(date, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def title_and_date(name: Column) -> tuple[Column, Column]:
    """Title and ISO date (or empty) from a file's name without suffix."""
    for pattern in (NAME_NUMBER, *NAME_SITES):
        name = F.regexp_replace(name, pattern, "")
    title, date = F.regexp_extract(name, NAME_DATE, 1), F.regexp_extract(name, NAME_DATE, 2)
    return F.when(date != "", title).otherwise(name), dashed(date)


def first_match(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The value of the first rule whose pattern is found."""
    out = F
    for pattern, value in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(otherwise)) if rules else F.lit(otherwise)


def authority_level(title: Column) -> Column:
    """Level of authority of a document by its title."""
    for pattern in LEVEL_DROPS:
        title = F.regexp_replace(title, pattern, "")
    return first_match(title, LEVELS, LEVEL_ELSE)


def strip_tail(text: Column, pattern: str = DATABASE_TAIL) -> Column:
    """A line without what databases append to it."""
    return F.trim(F.regexp_replace(text, pattern, ""))


def is_junk(text: Column, rules: tuple[str, ...] = LINE_RULES) -> Column:
    """Whether a line has no content of its own."""
    test = F.lit(False)
    for pattern in rules:
        test = test | text.rlike(pattern)
    return test


def running_lines(lines: DataFrame, *, doc: str = "doc_id", page: str = "page", text: str = "text", share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(doc, text, n_pages_with, n_pages): lines that stand on at least max(3, half) of a document's pages, if it has three."""
    counted = F.when((F.length(text) >= LEAST_LENGTH) & ~F.col(text).rlike(r"^\d+$"), F.col(text))
    # Lines are read once: each page has a row without text beside its texts, so of a document that row's count is the number of pages.
    held = lines.where(F.col(doc).isNotNull()).select(doc, page, F.explode(F.array(F.lit(None), counted)).alias(text)).distinct()
    counts = held.groupBy(doc, text).agg(F.count("*").alias("n_pages_with")).where(F.col(text).isNull() | (F.col("n_pages_with") >= least_pages))
    pages = F.max(F.when(F.col(text).isNull(), F.col("n_pages_with"))).over(Window.partitionBy(doc))
    found = counts.withColumn("n_pages", pages).where(F.col(text).isNotNull())
    return found.where((F.col("n_pages") >= least_pages) & (F.col("n_pages_with") >= F.col("n_pages") * F.lit(float(share)))).select(doc, text, "n_pages_with", "n_pages")


def clean_pages(lines: DataFrame, rules: tuple[str, ...] = LINE_RULES) -> DataFrame:
    """Lines without junk, running lines and page numbers at the start or end of a page; rows with a null page are kept as they are."""
    paged = lines.where("page is not null")
    kept = paged.where(~is_junk(F.col("text"), rules)).join(running_lines(paged).select("doc_id", "text"), ["doc_id", "text"], "left_anti")
    at = Window.partitionBy("doc_id", "page").orderBy("line_no")
    number = F.col("text") == F.col("page").cast("string")
    other = F.sum((~number).cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_lead", number & (other == 0))  # only page numbers so far
    kept = kept.where("not _lead")
    last = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no")))
    kept = kept.withColumn("_last", last).where(~(number & (F.col("_last") == 1)))
    return kept.select(*lines.columns).unionByName(lines.where("page is null"))


def page_metadata(lines: DataFrame) -> DataFrame:
    """(doc_id, date, doc_no, status): date and number from page 1, status from the last lines of any page; empty if not found."""
    near = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("line_no")))
    x = lines.where("page is not null").withColumn("_near", near)
    ordered = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("line_no", "text")))), lambda s: s["text"]), "\n")
    x = x.groupBy("doc_id").agg(ordered(F.col("page") == 1).alias("head"), ordered(F.col("_near") <= STATUS_LINES).alias("ends"))
    part = lambda i: F.lpad(F.regexp_extract("head", DATE, i), 4 if i == 1 else 2, "0")
    date = F.when(F.col("head").rlike(DATE), F.concat_ws("-", part(1), part(2), part(3))).otherwise("")
    return x.select("doc_id", date.alias("date"), F.regexp_extract("head", NUMBER, 1).alias("doc_no"), F.regexp_extract("ends", STATUS, 1).alias("status"))


def with_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Metadata in order of precedence: date of name, page, override; status of page, override; type of override, title.

    ``docs`` has file_name, title, name_date, page_date, page_status; ``overrides`` file_name, doc_type, effective_date, status.
    """
    over = overrides.select("file_name", F.col("doc_type").alias("_type"), F.col("effective_date").alias("_date"), F.col("status").alias("_status"))
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    x = docs.join(over, "file_name", "left").withColumn("_level", authority_level(F.col("title")))
    return x.select(*docs.columns, some("_type", "_level").alias("doc_type"), some("name_date", "page_date", "_date").alias("effective_date"), some("page_status", "_status").alias("status"))
