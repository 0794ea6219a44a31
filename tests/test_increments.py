"""Builds that go on from the last one: what is read, cut and encoded, and that a build is as one from nothing."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from provenant import cli
from provenant.operators import index
from provenant.sources import files, increments

RULE = "".join(f"第{n}条 {{}}业务应当遵守第{n}项规定，并保存单据备查，期限为{n}年。\n" for n in "一二三四五六七")


def put(folder, name, topic, head=""):
    (folder / name).write_text(head + RULE.replace("{}", topic), encoding="utf-8")


class World:
    """A folder, an output, and logs of what readers and the encoder were given."""

    def __init__(self, spark, tmp):
        self.spark, self.folder, self.out, self.log = spark, tmp / "in", str(tmp / "out"), tmp / "log"
        self.folder.mkdir()
        self.log.mkdir()

    def seen(self, what):
        try:
            return sorted((self.log / what).read_text().splitlines())
        except FileNotFoundError:
            return []
        finally:
            (self.log / what).unlink(missing_ok=True)

    def update(self, out=None, **kw):
        log = str(self.log)

        def reader(content):
            with open(f"{log}/read", "a") as f:
                f.write(content.decode().splitlines()[0][:12] + "\n")
            return [content.decode().splitlines()]

        def load():
            def encode(texts):
                with open(f"{log}/encoded", "a") as f:
                    f.writelines(t.split("\n")[0] + "\n" for t in texts)
                return index.hashing_encoder(texts)

            return encode

        return increments.update(self.spark, str(self.folder), out or self.out, load, readers={".pdf": reader}, **kw)

    def tables(self, path):
        vectors, postings = index.read_index(self.spark, f"{path}/index")
        rows = lambda df, *cols: sorted(map(str, df.select(*cols).collect()))
        return (
            rows(files.read_chunks(self.spark, f"{path}/chunks"), "chunk_id", "doc_id", "source_file", "text", "pos", "access"), rows(vectors, "chunk_id", "text", "vector", "is_case"), rows(postings, "chunk_id", "token", "weight"),
            rows(self.spark.read.parquet(f"{path}/pairs"), "*"), rows(self.spark.read.parquet(f"{path}/copies"), "*"), rows(increments.report(self.spark, path), "*"),
        )


@pytest.fixture
def world(spark, tmp_path):
    w = World(spark, tmp_path)
    put(w.folder, "a.pdf", "个人外汇")
    put(w.folder, "b.pdf", "大额现金")
    put(w.folder, "c.md", "账户管理", "---\ntitle: 丙办法\ndoc_id: INT-1\n---\n")
    return w


def test_only_what_is_new_is_read_cut_and_encoded(world, spark, tmp_path):
    world.update()
    world.seen("read"), world.seen("encoded")
    put(world.folder, "b.pdf", "跨境汇款")  # changed
    put(world.folder, "d.pdf", "贸易融资")  # new
    put(world.folder, "e.md", "个人外汇", "---\ndoc_id: INT-2\n---\n")  # contains the rules of a.pdf, and is preferred
    os.utime(world.folder / "c.md", (1, 1))  # touched
    got = world.update()
    assert got.n_read == 4 and world.seen("read") == sorted(["第一条 跨境汇款业务应当", "第一条 贸易融资业务应当"])
    assert len(world.seen("encoded")) == 21 and got.n_cut == 3  # b, d and e; c has nothing new
    chunks = files.read_chunks(spark, f"{got.path}/chunks")
    assert {r["doc_id"]: r["source_file"] for r in chunks.select("doc_id", "source_file").distinct().collect()} == {"PUB-002": "b.pdf", "PUB-003": "d.pdf", "INT-1": "c.md", "INT-2": "e.md"}
    assert world.tables(got.path) == world.tables(world.update(str(tmp_path / "anew")).path)  # as from nothing
    # the better copy goes: the other is back without being read, as is a content under another name; a number isn't given twice
    world.seen("read"), world.seen("encoded")
    (world.folder / "e.md").unlink()
    (world.folder / "d.pdf").rename(world.folder / "f.pdf")
    got = world.update()
    assert (got.n_read, got.n_gone, got.n_cut) == (1, 2, 2) and world.seen("read") == [] and len(world.seen("encoded")) == 14
    x = cli.library(spark, world.out)
    assert {r["doc_id"]: r["source_file"] for r in x.chunks.select("doc_id", "source_file").distinct().collect()} == {"PUB-001": "a.pdf", "PUB-002": "b.pdf", "PUB-004": "f.pdf", "INT-1": "c.md"}
    assert x.postings.join(x.chunks, "chunk_id", "left_anti").count() == 0 and x.vectors.count() == 28


def test_unchanged_folders_and_broken_builds(world, spark, monkeypatch):
    first = world.update()
    assert first.new and (first.n_read, first.n_cut) == (3, 3) and len(world.seen("read")) == 2 and len(world.seen("encoded")) == 21
    # another content of the same length and time: only who opens the file could tell
    for name in ("a.pdf", "c.md"):
        at = os.stat(world.folder / name)
        data = bytearray((world.folder / name).read_bytes())
        data[-10:-4] = b"xxxxxx"
        (world.folder / name).write_bytes(data)
        os.utime(world.folder / name, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert world.update() == increments.Update(first.path, False, 0, 0, 0) and world.seen("read") == world.seen("encoded") == []
    # a build that breaks off isn't there, but what readers gave it is
    put(world.folder, "d.pdf", "贸易融资")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(index, "write_index", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        world.update()
    assert increments.current(spark, world.out) == first.path and cli.library(spark, world.out).chunks.count() == 21 and len(world.seen("read")) == 1
    over = spark.createDataFrame([("d.pdf", "法律", "", "")], "file_name string, doc_type string, effective_date string, status string")
    got = world.update(overrides=over)
    assert got.n_read == 1 and world.seen("read") == []
    assert cli.library(spark, world.out).chunks.where("doc_type = '法律'").count() == 7
    # two documents of one id
    (world.folder / "twice.md").write_text("---\ndoc_id: INT-1\n---\n" + RULE.replace("{}", "其他"), encoding="utf-8")
    with pytest.raises(ValueError, match="INT-1"):
        world.update(overrides=over)
    assert increments.current(spark, world.out) == got.path
    # an empty folder
    for p in world.folder.iterdir():
        p.unlink()
    (world.folder / ".hidden").write_text("x")
    got = world.update()
    assert (got.n_read, got.n_gone) == (0, 4) and files.read_chunks(spark, f"{got.path}/chunks").count() == 0
    assert not os.path.exists(first.path) and len([p for p in os.listdir(world.out) if p.startswith("build-")]) == increments.KEPT


def test_moments(spark):
    x = spark.range(500).select(F.timestamp_micros(F.col("id") * 1000).alias("modified"))
    few, many = files.Moments.of(x.where("id in (3, 7)")), files.Moments.of(x.where("id between 10 and 400"))
    assert x.where(few.hold(F.col("modified"))).count() == 2 and x.where(many.hold(F.col("modified"))).count() == 391
    assert x.where(files.Moments.of(x.where("false")).hold(F.col("modified"))).count() == 1  # the first moment of all, which no file is told by
