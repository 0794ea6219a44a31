"""Builds that go on from the last one.

A build is a folder ``build-<n>`` under the output folder, and is there once its mark is: a file that is made when all its tables are written, so readers see a whole build or the
one before. Its manifest says which files it was made from. The next build lists the folder without opening a file, opens those that are new or were changed, compares their
documents with each other and with the rest, and cuts and encodes documents whose content or metadata is new; what is gone from the folder is gone from all its tables. An
unchanged folder gives no new build. Chunks and vectors that stay are copied as they are, and the lists and blocks of the index are made anew from them.

What readers gave is kept by a digest of the content, for all builds, in ``pages``: files that move, or come back, aren't recognised again, nor are those of a build that broke off.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from provenant.operators import dedupe, index, segment
from provenant.session import checkpointed, written

from . import files, loading

MANIFEST = "path string, modified timestamp, length long, settings string"
PAGES = "digest string, page int, line_no int, text string"
#: Builds that stay when a new one is there: readers may still be at the one before.
KEPT = 2
_MARK, _NAME = "_COMMITTED", re.compile(r"build-(\d+)")


@dataclass
class Update:
    """``path`` of the build that is there now; whether it is ``new``; numbers of files that were read and left, and of documents that were cut."""

    path: str
    new: bool
    n_read: int
    n_gone: int
    n_cut: int


class Builds:
    """The builds under a folder, by number."""

    def __init__(self, spark: SparkSession, out: str):
        self.out, self.jvm = out.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path(self.out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        """All that were begun, a list as long as builds are kept."""
        top = self._path(self.out)
        names = [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted(int(m[1]) for m in map(_NAME.fullmatch, names) if m)

    def path(self, n: int) -> str:
        return f"{self.out}/build-{n}"

    def current(self) -> str | None:
        """The last build that is whole."""
        whole = [n for n in self.numbers() if self.fs.exists(self._path(f"{self.path(n)}/{_MARK}"))]
        return self.path(whole[-1]) if whole else None

    def begin(self) -> str:
        """A folder for a new build; of two at once one fails here."""
        n = max(self.numbers(), default=0) + 1
        self.fs.mkdirs(self._path(self.out))
        if not self.fs.createNewFile(self._path(f"{self.path(n)}/_BEGUN")):
            raise FileExistsError(self.path(n))
        return self.path(n)

    def commit(self, path: str, kept: int = KEPT) -> None:
        """Make a build the current one, in one step, and remove those that nobody needs."""
        self.fs.createNewFile(self._path(f"{path}/{_MARK}"))
        mine = int(_NAME.fullmatch(path.rsplit("/", 1)[1])[1])
        for n in [n for n in self.numbers() if n < mine][: -(kept - 1) or None]:
            self.fs.delete(self._path(self.path(n)), True)


def current(spark: SparkSession, out: str) -> str:
    """The folder of the build that is there."""
    if not (path := Builds(spark, out).current()):
        raise FileNotFoundError(f"no build in {out}")
    return path


def update(
    spark: SparkSession, folder: str, out: str, load: Callable[[], index.Encoder] | None = None, overrides: DataFrame | None = None, readers: dict[str, files.Reader] | None = None, *, excluded_files: tuple[str, ...] = (), version: str = ""
) -> Update:
    """Bring the build under ``out`` up to a folder of documents.

    ``overrides`` and ``readers`` are those of ``loading.load``; a file whose override changes counts as changed. ``version`` names the encoder and the readers: with another one all files are read, and all documents are cut and encoded.
    A file is taken as unchanged while its path, length and time of change are. Raises ValueError if two chunks have one id; the current build stays then.
    """
    builds = Builds(spark, out)
    last = builds.current()
    readers = files.READERS | (readers or {})
    stored = lambda name, schema=None: spark.read.parquet(f"{last}/{name}") if last else spark.createDataFrame([], schema)

    listed = files.scan(spark, folder, excluded_files=excluded_files).drop("content").where(F.col("taken") & loading.readable(readers))
    if overrides is not None:
        over = overrides.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("doc_type", "effective_date", "status"))).alias("o"))
        listed = listed.join(over, "file_name", "left").withColumn("settings", F.concat(F.lit(version), F.coalesce(F.to_json("o"), F.lit("")))).drop("o")
    else:
        listed = listed.withColumn("settings", F.lit(version))
    listed = checkpointed(listed)
    before = stored("manifest", MANIFEST)
    same = ["path", "modified", "length", "settings"]
    fresh = checkpointed(listed.join(before, same, "left_anti"))
    gone = before.join(listed, "path", "left_anti")
    n_read, n_gone = fresh.count(), gone.count()
    if last and not n_read and not n_gone:
        return Update(last, False, 0, 0, 0)

    registry = stored("registry", "path string, doc_id string")
    ids = checkpointed(dedupe.stable_ids(listed.where("suffix <> '.md'").select("path"), registry))
    read, pages = loading.read(spark, folder, fresh, ids, overrides, readers, _cache(spark, builds.out), excluded_files=excluded_files, whole=not last)
    pages.write.mode("append").parquet(f"{builds.out}/pages")
    mark = F.sha2(F.to_json(F.struct(F.lit(version).alias("_version"), *read.columns), {"ignoreNullFields": "false"}), 256)
    read = written(read.withColumn("mark", mark))

    path = builds.begin()
    write = lambda df, name: df.write.parquet(f"{path}/{name}")
    old = stored("documents", read.schema)
    stays = old.join(fresh.select("path"), "path", "left_anti").join(listed.select("path"), "path", "left_semi")
    alike = read.join(old.select("path", "mark"), ["path", "mark"], "left_semi")  # touched, with nothing new
    changed = read.join(old.select("path", "mark"), ["path", "mark"], "left_anti")
    write(stays.unionByName(read), "documents")
    every = spark.read.parquet(f"{path}/documents")

    # pairs of documents that stay are known
    rest, new = loading.shingles(stays.unionByName(alike)), loading.shingles(changed)
    kept = stays.select("path").unionByName(alike.select("path"))
    pairs = stored("pairs", "a string, b string, shared long, sim double").join(kept.withColumnRenamed("path", "a"), "a", "left_semi").join(kept.withColumnRenamed("path", "b"), "b", "left_semi")
    if changed.limit(1).count():
        pairs = pairs.unionByName(_pairs(dedupe.containment_pairs(new, key="path")))
        if last:
            pairs = pairs.unionByName(_pairs(dedupe.containment_pairs(new, rest, key="path")))
    write(pairs, "pairs")
    copies = dedupe.resolve(spark.read.parquet(f"{path}/pairs"), loading.preference(every))
    write(copies, "copies")
    alive = dedupe.survivors(every, spark.read.parquet(f"{path}/copies"), key="path")

    # a document that stays a survivor keeps its chunks; one whose better copy went is cut now
    cut = stored("cut", "doc_id string, mark string")
    write(alive.select("doc_id", "mark"), "cut")
    known = alive.join(cut, ["doc_id", "mark"], "left_semi").select("doc_id")
    todo = written(alive.join(cut, ["doc_id", "mark"], "left_anti").drop("mark"))
    n_cut = todo.count()
    parts = []
    if n_cut or not last:
        made, warned = segment.build(todo.withColumnRenamed("path", "source_file"))
        parts.append((made, warned, *index.build(made, load or (lambda: index.hashing_encoder))))
    if last:
        vectors, postings = index.read_index(spark, f"{last}/index")
        vectors = vectors.join(known, "doc_id", "left_semi").drop("is_case")
        parts.append((files.read_chunks(spark, f"{last}/chunks").join(known, "doc_id", "left_semi"), stored("warnings").join(known, "doc_id", "left_semi"), vectors, postings.join(vectors.select("chunk_id"), "chunk_id", "left_semi")))
    chunks, warnings, vectors, postings = (functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables) for tables in zip(*parts, strict=True))
    files.write_chunks(chunks, f"{path}/chunks")
    write(warnings, "warnings")
    if repeated := segment.repeated_ids(files.read_chunks(spark, f"{path}/chunks")).first():
        raise ValueError(f"chunk id stands more than once: {repeated['chunk_id']}")
    index.write_index(vectors, postings, f"{path}/index")
    write(registry.select("path", "doc_id").unionByName(ids.select("path", "doc_id")).distinct(), "registry")
    write(listed.select(*same), "manifest")
    builds.commit(path)
    return Update(path, True, n_read, n_gone, n_cut)


def _pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with the lesser path first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("shared").cast("long").alias("shared"), "sim")


def _cache(spark: SparkSession, out: str) -> DataFrame | None:
    """What readers gave so far; null before the first build."""
    try:
        return spark.read.schema(PAGES).parquet(f"{out}/pages")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_chunks, kinds, longest) of a build; a warning of a document is a row as well."""
    warnings = spark.read.parquet(f"{path}/warnings")
    return segment.corpus_report(files.read_chunks(spark, f"{path}/chunks")).unionByName(warnings.select("doc_id", F.lit(0).cast("long").alias("n_chunks"), F.col("warning").alias("kinds"), F.lit(0).alias("longest")))
