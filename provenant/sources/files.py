"""Readers of document folders, chunks, questions and evaluation details, and the sinks that go with them.

Markdown is read with DataFrame functions alone, .docx by a reader of its XML. PDF and .doc need a parser that isn't part of the engine: readers are
registered by suffix and run in ``mapInPandas``.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.session import small

# What is read and what isn't, and the gate under which a page has no text of its own.
SUFFIXES = (".md", ".docx", ".doc", ".pdf")
EXCLUDED_FOLDERS = ("Internal", ".ipynb_checkpoints")
DEFAULT_TYPE = "内部制度"
EVERYONE = "全员"
LEAST_CHARS_A_PAGE = 50
CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, doc_title string, doc_type string, source_file string, version string, effective_date string, doc_no string, status string, "
    "kind string, chapter string, section string, article string, article_no int, alias string, page_start int, page_end int, text string, citation string, pos long, access array<string>"
)
#: Columns of evaluation details, as they stand in files; two have other names in tables.
DETAILS = {
    "id": "string", "type": "string", "question": "string", "expect": "string", "refused": "boolean", "reason": "string", "verdict": "string", "top_score": "double", "hit@1": "boolean", "hit@k": "boolean", "gold_rank": "int",
    "has_gold": "boolean", "gold": "list", "cited": "list", "cited_gold": "boolean", "dropped_citations": "int", "dropped_detail": "list", "missing_points": "list", "points_ok": "boolean", "expect_case": "boolean", "cases_shown": "list",
    "case_ok": "boolean", "retrieved": "list", "answer": "string", "key": "string", "seconds": "double",
}
DETAIL_NAMES = {"hit@1": "hit_at_1", "hit@k": "hit_at_k"}

Reader = Callable[[bytes], list[list[str]]]


@dataclass
class Moments:
    """When files were changed, in microseconds: each moment, or without them the first and the last. Scans use it to open no others; it may hold for files that aren't meant."""

    #: Moments that are told one by one; of more, the range is.
    MOST = 200

    each: list[int]
    first: int
    last: int

    @classmethod
    def of(cls, files: DataFrame) -> Moments:
        """Of files with a column ``modified``."""
        micros = F.unix_micros("modified").alias("m")
        each = [r["m"] for r in files.select(micros).distinct().limit(cls.MOST + 1).collect()]
        ends = files.agg(F.min(F.unix_micros("modified")).alias("a"), F.max(F.unix_micros("modified")).alias("b")).first()
        return cls(each if len(each) <= cls.MOST else [], ends["a"] or 0, ends["b"] or 0)

    def hold(self, modified: Column) -> Column:
        at = lambda m: F.timestamp_micros(F.lit(m))
        if self.each:
            return functools.reduce(lambda x, y: x | y, (modified == at(m) for m in self.each))
        return (modified >= at(self.first)) & (modified <= at(self.last))


def scan(
    spark: SparkSession, folder: str, *, excluded_folders: tuple[str, ...] = EXCLUDED_FOLDERS, excluded_files: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES, only: tuple[str, ...] = (), moments: Moments | None = None
) -> DataFrame:
    """(path, file_name, suffix, content, modified, length, taken): all files below a folder but hidden ones; taken is false for what isn't read.

    Content is read only if a later step asks for it, and only of files with the suffixes ``only`` (all without any) that were changed at ``moments``: both are decided before a file is opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if only:
        reader = reader.option("pathGlobFilter", "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in only) + "}")
    files = reader.load(folder)
    if moments is not None:
        files = files.where(moments.hold(F.col("modificationTime")))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    path = F.expr(f"substring(path, locate('{root}', path) + {len(root) + 1})") if "'" not in root else F.col("path")
    x = files.select(path.alias("path"), "content", F.col("modificationTime").alias("modified"), "length").withColumn("parts", F.split("path", "/")).withColumn("file_name", F.element_at("parts", -1))
    x = x.where(~F.col("file_name").startswith(".")).withColumn("suffix", F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1)))
    taken = F.col("suffix").isin(*suffixes) & ~F.arrays_overlap("parts", F.array(*map(F.lit, excluded_folders))) & ~F.col("file_name").isin(*excluded_files)
    return x.select("path", "file_name", "suffix", "content", "modified", "length", taken.alias("taken"))


# ---- front matter: an entry for each name at the start of a line, with the lines below that belong to it

_ENTRIES = "array<struct<name:string,head:string,more:array<string>>>"
_DOUBLE, _SINGLE = r'"(?:[^"\\]|\\.)*"', r"'(?:[^']|'')*'"


def entries(front: Column) -> Column:
    """Front matter by names: what stands behind each, and the lines below up to the next name. Comments and blank lines between names go."""
    named = r"^([\p{L}_][\p{L}\p{N}_-]*):(?:[ \t]+(.*?))?[ \t]*$"

    def step(z: Column, line: Column) -> Column:
        fresh = F.struct(F.regexp_extract(line, named, 1).alias("name"), F.regexp_extract(line, named, 2).alias("head"), F.array().cast("array<string>").alias("more"))
        last = F.element_at(z, -1)
        longer = F.struct(last["name"].alias("name"), last["head"].alias("head"), F.concat(last["more"], F.array(line)).alias("more"))
        return F.when(line.rlike(named), F.concat(z, F.array(fresh))).when((F.size(z) == 0) | line.startswith("#"), z).otherwise(F.concat(F.slice(z, 1, F.size(z) - 1), F.array(longer)))

    return F.aggregate(F.split(front, "\n"), F.array().cast(_ENTRIES), step)


def _plain(text: Column) -> Column:
    """One scalar on a line: quoted either way, or plain up to a comment."""
    trimmed = F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")
    double = F.regexp_extract(trimmed, rf"^({_DOUBLE})", 1)
    inner = F.substring(double, F.lit(2), F.length(double) - 2)
    hidden = F.replace(inner, F.lit("\\\\"), F.lit("\u0001"))
    for sign, meant in ((r"\"", '"'), (r"\n", "\n"), (r"\t", "\t"), (r"\/", "/")):
        hidden = F.replace(hidden, F.lit(sign), F.lit(meant))
    single = F.regexp_extract(trimmed, rf"^({_SINGLE})", 1)
    bare = F.regexp_replace(trimmed, r"(^|[ \t]+)#.*$", "")
    return F.when(double != "", F.replace(hidden, F.lit("\u0001"), F.lit("\\"))).when(single != "", F.replace(F.substring(single, F.lit(2), F.length(single) - 2), F.lit("''"), F.lit("'"))).otherwise(bare)


def scalar(entry: Column) -> Column:
    """An entry as a text: quoted, plain (over several lines as well), literal (``|``) or folded (``>``); null for a null entry."""
    head, more = entry["head"], entry["more"]
    width = F.length(F.regexp_extract(F.try_element_at(F.filter(more, lambda x: F.trim(x) != ""), F.lit(1)), r"^([ \t]*)", 1))
    body = F.regexp_replace(F.array_join(F.transform(more, lambda x: F.substr(x, F.coalesce(width, F.lit(0)) + 1)), "\n"), r"\n+$", "")
    end = F.when(head.rlike(r"^[|>]-") | (body == ""), "").otherwise("\n")
    folded = F.replace(F.replace(F.replace(body, F.lit("\n\n"), F.lit("\u0001")), F.lit("\n"), F.lit(" ")), F.lit("\u0001"), F.lit("\n"))
    lines = F.filter(F.concat(F.array(head), F.transform(more, lambda x: F.trim(x))), lambda x: x != "")
    return F.when(head.rlike(r"^\|[-+]?\s*$"), F.concat(body, end)).when(head.rlike(r"^>[-+]?\s*$"), F.concat(folded, end)).otherwise(_plain(F.array_join(lines, " ")))


def listed(entry: Column) -> Column:
    """An entry as a list: in brackets, with a dash for each item, or a single text; empty for a null entry."""
    whole = F.array_join(F.concat(F.array(entry["head"]), F.transform(entry["more"], lambda x: F.trim(x))), " ")
    inside = F.regexp_extract(whole, rf"^\s*\[((?:{_DOUBLE}|{_SINGLE}|[^\]])*)\]", 1)
    flow = F.regexp_extract_all(inside, F.lit(rf"[ \t]*({_DOUBLE}|{_SINGLE}|[^,]+)"), F.lit(1))
    dashed = F.filter(F.transform(entry["more"], lambda x: F.trim(x)), lambda x: x.rlike(r"^-[ \t]+"))
    items = F.when(whole.rlike(r"^\s*\["), flow).when(F.size(dashed) > 0, F.transform(dashed, lambda x: F.regexp_replace(x, r"^-[ \t]+", ""))).otherwise(F.array(scalar(entry)))
    return F.coalesce(F.filter(F.transform(items, _plain), lambda x: x != ""), F.array().cast("array<string>"))


def entry(front: Column, name: str) -> Column:
    """The entry of a name, the last of several; null without one."""
    return F.try_element_at(F.filter(front, lambda e: e["name"] == name), F.lit(-1))


def read_markdown(files: DataFrame) -> DataFrame:
    """(path, doc_id, doc_title, doc_type, access, version, effective_date, lines) of Markdown files: front matter, then non-empty lines without leading #."""
    x = files.where("suffix = '.md' and taken").withColumn("raw", F.decode("content", "utf-8"))
    front = F.regexp_extract("raw", r"(?s)^---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("raw", r"(?s)^---\n.*?\n---\n", "")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    x = x.withColumns({"front": entries(front), "body": body, "stem": stem})
    text = F.transform(F.split("body", r"\r\n|[\n\r]"), lambda t: F.regexp_replace(t, r"^#*\s*|\s+$", ""))
    lines = F.transform(F.filter(text, lambda t: t != ""), lambda t: F.struct(t.alias("text"), F.lit(None).cast("int").alias("page")))
    get = lambda name, other: F.coalesce(scalar(entry(F.col("front"), name)), other)
    return x.select("path", get("doc_id", F.col("stem")).alias("doc_id"), get("title", F.col("stem")).alias("doc_title"), get("doc_type", F.lit(DEFAULT_TYPE)).alias("doc_type"), listed(entry(F.col("front"), "access")).alias("access"), get("version", F.lit("")).alias("version"), get("effective_date", F.lit("")).alias("effective_date"), lines.alias("lines"))


def read_pages(files: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """(path, page, line_no, text) by registered readers: a reader turns a file's bytes into pages of lines. Files of formats without pages have page null."""
    return read_new(files, readers).where("line_no >= 0").select("path", "page", "line_no", "text")


def read_new(files: DataFrame, readers: dict[str, Reader], cache: DataFrame | None = None) -> DataFrame:
    """(path, digest, page, line_no, text) by registered readers, for contents that ``cache`` (digest, page, line_no, text) lacks; each file has a row with line_no -1 and its digest, whether it was read or not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, suffix, content, digest, known in zip(*(frame[c] for c in ("path", "suffix", "content", "digest", "known")), strict=True):
                out.append((path, digest, None, -1, None))
                n = 0
                for page, lines in enumerate([] if known else readers[suffix](bytes(content)), 1):
                    for t in lines:
                        if t.strip():
                            out.append((path, digest, page if suffix == ".pdf" else None, n, t.strip()))
                            n += 1
            yield pd.DataFrame(out, columns=["path", "digest", "page", "line_no", "text"]).astype({"page": "object"})

    x = files.where(F.col("taken") & F.col("suffix").isin(*readers)).select("path", "suffix", "content", digest_of(F.col("content"), F.col("suffix")).alias("digest"))
    if cache is None:
        x = x.withColumn("known", F.lit(False))
    else:
        x = x.join(small(cache.where("line_no = -1").select("digest", F.lit(True).alias("known")).distinct()), "digest", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return x.select("path", "suffix", "content", "digest", "known").mapInPandas(run, "path string, digest string, page int, line_no int, text string")


def digest_of(content: Column, suffix: Column) -> Column:
    """What names a content in the cache: the suffix chooses the reader, so it belongs to the name."""
    return F.concat(F.md5(content), suffix)


def read_docx(content: bytes) -> list[list[str]]:
    """Paragraphs of a .docx file, as one page."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    signs = {f"{name}tab": "\t", f"{name}br": "\n"}
    return [["".join(x.text or "" if x.tag == f"{name}t" else signs.get(x.tag, "") for x in p.iter()) for p in body.iter(f"{name}p")]]


READERS: dict[str, Reader] = {".docx": read_docx}


def scanned(lines: DataFrame, n_pages: DataFrame) -> DataFrame:
    """(path) of files with fewer than 50 characters a page: images, which need recognition. ``n_pages``: path, n_pages."""
    chars = lines.groupBy("path").agg(F.sum(F.length("text")).alias("chars"))
    return n_pages.join(chars, "path", "left").where(F.coalesce("chars", F.lit(0)) < LEAST_CHARS_A_PAGE * F.col("n_pages")).select("path")


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content isn't in the recognition cache, by a hash of the content; adds ``digest``."""
    x = files.withColumn("digest", F.substring(F.md5("content"), 1, 12))
    return x.join(cache.select("digest"), "digest", "left_anti")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines. Rows of a file have no order that lasts, so each chunk carries its place in its document (``pos``)."""
    chunks.select(*(c.split()[0] for c in CHUNK_SCHEMA.split(", ") if c.split()[0] in chunks.columns)).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines, in the fixed schema. In files without ``pos`` it is the chunk's place in its file: a block's start, and rows from there."""
    x = spark.read.schema(CHUNK_SCHEMA).json(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return x.withColumn("pos", F.coalesce("pos", F.col("_metadata.file_block_start") + row))


QUESTION_SCHEMA = "id string, type string, mode string, question string, gold array<string>, must array<string>, expect string, expect_case boolean, key string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON lines, or of a YAML list; without gold or key points they have empty lists, without ``expect`` they are to be answered unless out of scope."""
    if path.endswith((".yaml", ".yml")):
        import json

        import yaml

        text = spark.read.text(path, wholetext=True).first()[0]  # a file that people write
        x = spark.createDataFrame([(json.dumps(q, ensure_ascii=False, default=str),) for q in yaml.safe_load(text) or []], "raw string").select(F.from_json("raw", QUESTION_SCHEMA).alias("q")).select("q.*")
    else:
        x = spark.read.schema(QUESTION_SCHEMA).json(path)
    empty = F.array().cast("array<string>")
    expect = F.coalesce("expect", F.when(F.col("type") == "out_of_kb", "refuse").otherwise("answer"))
    return x.withColumns({"gold": F.coalesce("gold", empty), "must": F.coalesce("must", empty), "expect": expect})


def with_ids(questions: DataFrame, ids: str) -> DataFrame:
    """The questions of a comma-separated list of ids; all for an empty list."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    return questions.where(F.col("id").isin(*wanted)) if wanted else questions


def write_details(rows: DataFrame, path: str) -> None:
    """Evaluation rows as CSV with a byte-order mark and a header: known columns first, in their order and by their names in files; lists as JSON, True and False."""
    known = {DETAIL_NAMES.get(c, c): c for c in DETAILS if DETAIL_NAMES.get(c, c) in rows.columns}
    order = [*known, *(c for c in rows.columns if c not in known)]
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.to_json(c)
        return F.when(F.col(c), "True").when(~F.col(c), "False") if kinds[c] == "boolean" else F.col(c)

    marked = rows.select(*(cell(c).alias(known.get(c, c)) for c in order))
    marked.withColumnRenamed(marked.columns[0], "\ufeff" + marked.columns[0]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows from CSV in the types of ``DETAILS``, as ``evaluate`` takes them; a byte-order mark is passed over.

    Known columns that the file lacks are null (lists: empty), but without has_gold all but out-of-scope questions have gold. Other columns stay as text.
    """
    x = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    x = x.withColumnsRenamed({c: c.lstrip("\ufeff") for c in x.columns if c.startswith("\ufeff")})
    empty = F.array().cast("array<string>")

    def cell(c: str, kind: str) -> Column:
        there = c in x.columns
        value = F.col(f"`{c}`") if there else F.lit(None).cast("string")
        if kind == "list":
            return F.coalesce(F.from_json(value, "array<string>"), empty)
        if c == "has_gold" and not there:
            return F.col("type") != "out_of_kb"
        typed = F.coalesce(value, F.lit("")) if kind == "string" and there else value.try_cast(kind)
        return F.coalesce(typed, F.lit(0.0)) if c == "seconds" else typed

    return x.select(*(cell(c, kind).alias(DETAIL_NAMES.get(c, c)) for c, kind in DETAILS.items()), *(f"`{c}`" for c in x.columns if c not in DETAILS))
