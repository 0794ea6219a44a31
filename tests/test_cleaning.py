from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from provenant.operators import cleaning as c


def lines(spark, rows):
    return spark.createDataFrame([("d", p, i, t) for i, (p, t) in enumerate(rows)], "doc_id string, page int, line_no int, text string")


def test_title_and_date(spark):
    x = spark.createDataFrame([("3.个人外汇管理办法_20070105",), ("外汇条例_行政规范性文件_中国政府网",), ("案例-陕西法院网",)], "n string")
    title, date = c.title_and_date(F.col("n"))
    assert [tuple(r) for r in x.select(title, date).collect()] == [("个人外汇管理办法", "2007-01-05"), ("外汇条例", ""), ("案例", "")]


def test_authority_level(spark):
    titles = {
        "中华人民共和国反洗钱法（2024修订）": "法律", "洗钱典型案例": "典型案例", "最高人民法院关于洗钱的解释": "司法解释", "外汇管理条例": "行政法规", "国务院关于外汇的决定": "行政法规",
        "个人外汇管理办法": "部门规章", "关于印发管理办法的通知": "规范性文件", "关于印发办法的通知管理办法": "规范性文件", "全国人民代表大会常务委员会关于惩治的决定": "法律", "公告": "规范性文件",
    }
    x = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r[0]: r[1] for r in x.select("t", c.authority_level(F.col("t"))).collect()} == titles


def test_clean_pages(spark):
    page = lambda n: [(n, "外汇局法规文件库"), (n, str(n)), (n, "打印"), (n, f"第{n}条正文"), (n, "https://example.com/a"), (n, f"{n}/3"), (n, "2024/1/2 10:30"), (n, "2024"), (n, str(n))]
    x = lines(spark, page(1) + page(2) + page(3))
    got = [(r["page"], r["text"]) for r in c.clean_pages(x).orderBy("line_no").collect()]
    assert got == [(n, t) for n in (1, 2, 3) for t in (f"第{n}条正文", "2024")]


def test_running_lines_need_three_pages(spark):
    x = lines(spark, [(1, "页眉页眉页眉"), (2, "页眉页眉页眉")])
    assert c.running_lines(x).count() == 0
    x = lines(spark, [(p, t) for p in range(1, 8) for t in (["页眉页眉页眉"] if p < 4 else ["正文"])])
    assert c.running_lines(x).count() == 0  # three of seven pages is less than half
    assert c.running_lines(lines(spark, [(p, t) for p in range(1, 7) for t in (["页眉页眉页眉"] if p < 4 else ["正文"])])).first()["n_pages_with"] == 3


def scans(x):
    """How often a plan reads files."""
    return x._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_running_lines_read_once(spark, tmp_path):
    lines(spark, [(p, t) for p in range(1, 5) for t in ("页眉页眉页眉", "12", "第一条正文正文")]).write.parquet(str(tmp_path / "lines"))
    x = spark.read.parquet(str(tmp_path / "lines"))
    got = c.running_lines(x)
    assert scans(got) == 1
    assert sorted(tuple(r) for r in got.collect()) == [("d", t, 4, 4) for t in sorted(("页眉页眉页眉", "第一条正文正文"))]
    assert scans(c.clean_pages(x)) == 3  # lines with pages, what runs, lines without


def test_running_lines_odd_rows(spark):
    texts = [None, "", "123456", "短", "aaaaaa", "bbbbbb", "cccccc", " " * 6]
    rows = [(d, p, texts[(7 * k + (d or 0)) % len(texts)]) for d in (None, 1, 2, 3, 4) for p in (None, 1, 2, 3, 4, 5) for k in range((d or 2) * (p or 1) % 5)]
    rows += [r for r in rows if r[0] == 2] + [(5, p, None) for p in (None, 1, 2)] + [(6, p, t) for p in (None, 1, 2) for t in ("aaaaaa", "x")] + [(7, p, "aaaaaa" if p < 3 else "123456") for p in range(5)]
    pages, held = defaultdict(set), defaultdict(set)
    for d, p, t in rows:
        if d is not None:
            pages[d].add(p)  # a null page is a page, and one without lines that count
            if t is not None and len(t) >= 6 and not re.fullmatch("[0-9]+", t):
                held[d, t].add(p)
    for share, least in ((0.5, 3), (0.1, 1), (1.0, 3)):
        want = sorted((d, t, len(p), len(pages[d])) for (d, t), p in held.items() if len(p) >= least and len(pages[d]) >= least and len(p) >= len(pages[d]) * share)
        got = c.running_lines(spark.createDataFrame(rows, "source int, no int, line string"), doc="source", page="no", text="line", share=share, least_pages=least)
        assert got.columns == ["source", "line", "n_pages_with", "n_pages"] and sorted(tuple(r) for r in got.collect()) == want and want
    assert c.running_lines(spark.createDataFrame([], "doc_id int, page int, text string")).count() == 0


def test_clean_pages_odd_rows(spark):
    rows = [(d, p, i, t) for d in ("d", None) for p in (1, 2, 3) for i, t in enumerate(("页眉页眉页眉", str(p), "正文", None, str(p)), 10 * p)] + [("d", None, 50, "页眉页眉页眉"), (None, None, 51, None), ("d", None, 52, "打印")]
    x = spark.createDataFrame(rows, "doc_id string, page int, line_no int, text string")
    got = sorted(tuple(map(str, r)) for r in c.clean_pages(x).collect())
    want = [("d", p, 10 * p + 2, "正文") for p in (1, 2, 3)] + rows[-3:]
    want += [(None, p, 10 * p + i, t) for p in (1, 2, 3) for i, t in enumerate(("页眉页眉页眉", p, "正文"))]  # what runs is told by document, and these have none
    assert got == sorted(tuple(map(str, r)) for r in want)


def test_page_metadata(spark):
    x = lines(spark, [(1, "发布日期：2024-3-5"), (1, "文 号：汇发〔2024〕5号"), (1, "a"), (2, "b"), (2, "（已废止）"), (2, "x"), (2, "y"), (2, "z")])
    assert tuple(c.page_metadata(x).first())[1:] == ("2024-03-05", "汇发〔2024〕5号", "已废止")
    x = lines(spark, [(2, "发布日期：2024-3-5"), (1, "（已修改）"), (1, "b"), (1, "c"), (1, "d"), (1, "e")])
    assert tuple(c.page_metadata(x).first())[1:] == ("", "", "")


def test_overrides(spark):
    docs = spark.createDataFrame([("a.pdf", "外汇管理条例", "", "2020-01-01", ""), ("b.pdf", "公告", "2021-01-01", "2020-01-01", "已修改"), ("c.pdf", "公告", "", "", "")], "file_name string, title string, name_date string, page_date string, page_status string")
    over = spark.createDataFrame([("a.pdf", "权威解读", "2019-01-01", "已废止"), ("c.pdf", None, "2018-01-01", None)], "file_name string, doc_type string, effective_date string, status string")
    got = {r["file_name"]: (r["doc_type"], r["effective_date"], r["status"]) for r in c.with_overrides(docs, over).collect()}
    assert got == {"a.pdf": ("权威解读", "2020-01-01", "已废止"), "b.pdf": ("规范性文件", "2021-01-01", "已修改"), "c.pdf": ("规范性文件", "2018-01-01", "")}


def test_strip_tail(spark):
    x = spark.createDataFrame([("正文法宝联想：案例",), ("修订沿革",), ("正文",)], "t string")
    assert [r[0] for r in x.select(c.strip_tail(F.col("t"))).collect()] == ["正文", "", "正文"]
