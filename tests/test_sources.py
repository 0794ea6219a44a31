from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import index as x
from provenant.sources import files as f


def test_folder(spark, tmp_path):
    (tmp_path / "sub" / "Internal").mkdir(parents=True)
    (tmp_path / "a.md").write_text("---\ntitle: 甲办法\ndoc_id: INT-1\nversion: \"2\"\n---\n# 第一章\n\n正文\n## 节 \n", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_text("无前言\n", encoding="utf-8")
    for name in ("sub/Internal/c.md", ".hidden.md", "d.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "e.pdf").write_bytes(b"p1 a|p1 b\fp2")
    found = f.scan(spark, str(tmp_path))
    assert {r["path"]: r["taken"] for r in found.collect()} == {"a.md": True, "sub/b.md": True, "sub/Internal/c.md": False, "d.txt": False, "e.pdf": True}
    docs = {r["doc_id"]: r for r in f.read_markdown(found).collect()}
    assert set(docs) == {"INT-1", "b"} and (docs["INT-1"]["doc_title"], docs["INT-1"]["version"], docs["b"]["doc_type"]) == ("甲办法", "2", f.DEFAULT_TYPE)
    assert [t["text"] for t in docs["INT-1"]["lines"]] == ["第一章", "正文", "节"]
    pages = f.read_pages(found, {".pdf": lambda b: [p.split("|") for p in b.decode().split("\f")]})
    assert [(r["page"], r["line_no"], r["text"]) for r in pages.orderBy("line_no").collect()] == [(1, 0, "p1 a"), (1, 1, "p1 b"), (2, 2, "p2")]
    counts = spark.createDataFrame([("e.pdf", 2)], "path string, n_pages int")
    assert [r["path"] for r in f.scanned(pages, counts).collect()] == ["e.pdf"]
    pdf = found.where("suffix = '.pdf'")
    digest = pdf.select(F.substring(F.md5("content"), 1, 12).alias("digest"))
    assert f.uncached(pdf, digest).count() == 0 and f.uncached(pdf, digest.where("false")).count() == 1


def test_round_trips(spark, tmp_path):
    rows = [("a", "normal", True, None, ["x,\"y", "行\n二"], 1.5)]
    d = spark.createDataFrame(rows, "id string, type string, refused boolean, case_ok boolean, cited array<string>, seconds double")
    f.write_details(d, str(tmp_path / "d"))
    got = f.read_details(spark, str(tmp_path / "d")).first()
    assert (got["refused"], got["case_ok"], got["cited"], got["seconds"], got["has_gold"]) == (True, None, ["x,\"y", "行\n二"], 1.5, True)
    (tmp_path / "bom.csv").write_text("﻿id,type,refused,cited,seconds\nq,out_of_kb,False,not json,\n", encoding="utf-8")
    got = f.read_details(spark, str(tmp_path / "bom.csv")).first()
    assert (got["id"], got["refused"], got["cited"], got["has_gold"], got["seconds"]) == ("q", False, [], False, 0.0)
    (tmp_path / "q.json").write_text('{"id":"N1","type":"normal","question":"问","expect":"answer"}\n{"id":"S1","type":"scenario","gold":["c"],"expect_case":true}\n', encoding="utf-8")
    q = f.read_questions(spark, str(tmp_path / "q.json"))
    assert {r["id"]: (r["gold"], r["expect_case"]) for r in q.collect()} == {"N1": ([], None), "S1": (["c"], True)}
    assert f.with_ids(q, "N1, X").count() == 1 and f.with_ids(q, "").count() == 2


def test_index(spark, tmp_path):
    c = spark.createDataFrame([("c1", "d", "甲", "法律", "第一章", "", "", "正文", None), ("c2", "d", "甲", "典型案例", "", "", "乙罪", "别的 abc abc", 3)], "chunk_id string, doc_id string, doc_title string, doc_type string, chapter string, section string, alias string, text string, page_start int")
    f.write_chunks(c, str(tmp_path / "chunks"))
    assert f.read_chunks(spark, str(tmp_path / "chunks")).where("chunk_id = 'c2' and page_start = 3").count() == 1
    heads = [r[0] for r in c.orderBy("chunk_id").select(x.embedding_text(*(F.col(k) for k in ("doc_title", "chapter", "section", "alias", "text")))).collect()]
    assert heads == ["《甲》 第一章\n正文", "《甲》 【乙罪】\n别的 abc abc"]
    vectors, postings = x.build(c)
    x.write_index(vectors, postings, str(tmp_path / "index"))
    v, p = x.read_index(spark, str(tmp_path / "index"))
    assert v.where("is_case").count() == 1 and len(v.first()["vector"]) == x.DENSE_SIZE
    assert p.where("token = 'abc'").first()["weight"] == 2.0
