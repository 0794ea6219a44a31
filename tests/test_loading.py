from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from provenant import cli
from provenant.operators import segment
from provenant.sources import files, loading

ARTICLES = "".join(f"第{n}条 个人办理外汇业务应当遵守第{n}项规定，并保存单据备查。\n" for n in "一二三四五六七")


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.个人外汇管理办法_20230102.docx").write_bytes(docx(*ARTICLES.splitlines(), "法宝联想：3篇"))
    (tmp_path / "in" / "个人外汇管理办法.pdf").write_bytes(("发布日期：2022-5-6\n" + ARTICLES + "\f" + "（已废止）").encode())
    (tmp_path / "in" / "内部.md").write_text("---\ntitle: 内部办法\ndoc_id: INT-1\n---\n# 说明\n本办法所称大额现金，是指五万元以上的现金。\n", encoding="utf-8")
    (tmp_path / "in" / "x.doc").write_bytes(b"?")
    return str(tmp_path / "in")


def test_load(spark, tmp_path):
    registry = spark.createDataFrame([("/gone.pdf", "PUB-007")], "path string, doc_id string")
    pdf = {".pdf": lambda b: [p.split("\n") for p in b.decode().split("\f")]}
    over = spark.createDataFrame([("个人外汇管理办法.pdf", "法律", "", "")], "file_name string, doc_type string, effective_date string, status string")
    got = loading.load(spark, folder(tmp_path), registry, over, pdf)
    docs = {r["doc_id"]: r for r in got.documents.collect()}
    assert {r["path"].lstrip("/") for r in got.skipped.collect()} == {"x.doc"}
    assert [(r["dropped"].lstrip("/"), r["kept"].lstrip("/")) for r in got.copies.collect()] == [("个人外汇管理办法.pdf", "1.个人外汇管理办法_20230102.docx")]
    assert set(docs) == {"PUB-008", "INT-1"} and docs["PUB-008"]["doc_title"] == "个人外汇管理办法" and docs["PUB-008"]["effective_date"] == "2023-01-02"
    assert [x["text"][:3] for x in docs["PUB-008"]["lines"]] == [f"第{n}条" for n in "一二三四五六七"]
    assert {r["doc_id"] for r in got.registry.collect()} == {"PUB-007", "PUB-008", "PUB-009"}


def planner(queries):
    return queries.select("query_id", F.lit('{"issues": [{"query": "外汇业务单据"}]}').alias("raw"))


def generator(asked):
    quote = F.regexp_extract("prompt", r"(?s)\\[S1\\] [^\\n]*\\n(.{8,20})", 1)
    return asked.select("query_id", F.to_json(F.struct(F.lit(True).alias("found"), F.lit("见[S1]").alias("answer"), F.lit("").alias("verdict"), F.array(F.struct(F.lit("S1").alias("source"), quote.alias("quote"))).alias("citations"))).alias("raw"))


def test_commands(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.main(["build", folder(tmp_path), out])
    again = cli.build(spark, str(tmp_path / "in"), out).collect()  # ids stay
    assert {r["doc_id"]: r["n_chunks"] for r in again} == {"PUB-001": 7, "INT-1": 1}
    cli.main(["search", out, "个人办理外汇业务 第三条"])
    assert "第三条" in capsys.readouterr().out
    x = cli.library(spark, out)
    # the stand-in score counts words without spaces, so the question is the chunk's own wording
    text = x.chunks.where("article = '第二条'").first()["text"]
    module = "tests.test_loading"
    cli.main(["ask", out, text, "--planner", f"{module}:planner", "--generator", f"{module}:generator"])
    assert "query_id" in capsys.readouterr().out
    (tmp_path / "q.yaml").write_text("# questions\n- {id: N01, type: normal, question: 个人办理外汇业务, gold: ['PUB-001#第一条'], must: ['单据|凭证']}\n- id: O01\n  type: out_of_kb\n  question: 天气\n", encoding="utf-8")
    q = {r["id"]: r for r in files.read_questions(spark, str(tmp_path / "q.yaml")).collect()}
    assert (q["N01"]["expect"], q["O01"]["expect"], q["O01"]["gold"], q["N01"]["must"]) == ("answer", "refuse", [], ["单据|凭证"])
    cli.main(["eval", out, str(tmp_path / "q.yaml"), "--details", str(tmp_path / "details"), "--page", str(tmp_path / "page.html")])
    assert "retrieval hit" in capsys.readouterr().out and "with issues" in (tmp_path / "page.html").read_text()
    assert files.read_details(spark, str(tmp_path / "details")).count() == 2
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbf") for p in (tmp_path / "details").glob("part-*"))


def test_chunks_keep_their_order(spark, tmp_path):
    """Ten packs and more of an item, and parts of a case: as built, so read."""
    docs = spark.createDataFrame([("D", "甲条例", "规范性文件", "p", [(t, None) for t in ["前言" * 20, *[f"一、事项{'长' * 700}", *(f"（{'一二三四五六七八九'[i % 9]}）分项{i}{'长' * 700}" for i in range(13))], "二、另一项", "三、再一项"]])], "doc_id string, doc_title string, doc_type string, source_file string, lines array<struct<text:string,page:int>>")
    made = segment.build(docs)[0]
    want = [r["chunk_id"] for r in made.orderBy("doc_id", "pos").collect()]
    files.write_chunks(made.repartition(3, "chunk_id"), str(tmp_path / "chunks"))
    read = files.read_chunks(spark, str(tmp_path / "chunks"))
    assert [r["chunk_id"] for r in read.orderBy("doc_id", "pos").collect()] == want and len(want) > 12
    assert sorted(want) != want  # names don't give the order
    (tmp_path / "plain.jsonl").write_text("".join('{"chunk_id": "c%d", "doc_id": "d"}\n' % i for i in (3, 1, 2)))
    assert [r["chunk_id"] for r in files.read_chunks(spark, str(tmp_path / "plain.jsonl")).orderBy("pos").collect()] == ["c3", "c1", "c2"]
