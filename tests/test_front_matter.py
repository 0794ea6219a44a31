"""Front matter against a YAML parser, on odd headers."""

from __future__ import annotations

import yaml
from pyspark.sql import functions as F

from provenant.sources import files as f

HEADERS = [
    "title: 甲办法\naccess: [全员, \"a, b\", 'it''s']\nversion: \"2\"",
    "title: \"say \\\"hi\\\" \\\\ there\"  # comment\naccess:\n  - one\n  - \"two: 2\"\n  - 'three'\nversion: 'v''1'",
    "# a comment\ntitle: |\n  line one\n    indented\n  line two\naccess: []\nversion: x",
    "title: >\n  folded\n  text\n\n  after a blank\nversion: >-\n  no end\n  here\naccess:\n- flush\n- left",
    "title: |-\n  kept: as is\n  - not a list\nversion: plain # cut\naccess: [ 'x' , y ]",
    "title: plain over\n  two lines\nversion: a#b\naccess: [multi,\n  line]",
    "title: |\nversion: a\naccess: [b]",
    "title: \"it: has a colon\"\nversion: 'a # b'\naccess:\n    - deep",
]


def test_front_matter_is_yaml(spark):
    x = spark.createDataFrame(list(enumerate(HEADERS)), "i int, front string").withColumn("e", f.entries(F.col("front")))
    x = x.select("i", f.scalar(f.entry(F.col("e"), "title")).alias("title"), f.scalar(f.entry(F.col("e"), "version")).alias("version"), f.listed(f.entry(F.col("e"), "access")).alias("access"), f.scalar(f.entry(F.col("e"), "none")).alias("none"), f.listed(f.entry(F.col("e"), "none")).alias("nothing"))
    for r in x.collect():
        want = yaml.safe_load(HEADERS[r["i"]])
        assert (r["title"], r["version"], r["access"]) == (want["title"], want["version"], want["access"]), r["i"]
        assert r["none"] is None and r["nothing"] == []


def test_access_reaches_the_chunks(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 甲\naccess:\n  - 财务\n  - 法务\n---\n一段正文，足够长的一段正文，用来成为一个片段。\n" * 1, encoding="utf-8")
    docs = f.read_markdown(f.scan(spark, str(tmp_path)))
    assert docs.first()["access"] == ["财务", "法务"]
    chunks = docs.select(F.lit("c").alias("chunk_id"), "doc_id", "access", F.lit(0).cast("long").alias("pos"))
    f.write_chunks(chunks, str(tmp_path / "chunks"))
    assert f.read_chunks(spark, str(tmp_path / "chunks")).first()["access"] == ["财务", "法务"]
