from __future__ import annotations

import random

from pyspark.sql import functions as F

from provenant.operators import enrich, retrieve as r, rules


def ranks(spark, rows):
    return spark.createDataFrame([(1, c, k) for k, c in enumerate(rows, 1)], "query_id int, chunk_id string, rank int")


def test_fuse_ties_and_symmetry(spark):
    got = r.fuse(ranks(spark, ["a", "b"]), ranks(spark, ["b", "a", "c"])).orderBy("fused_rank").collect()
    assert [x["chunk_id"] for x in got] == ["a", "b", "c"] and got[0]["rrf"] == got[1]["rrf"] == 1 / 61 + 1 / 62
    back = {x["chunk_id"]: x["rrf"] for x in r.fuse(ranks(spark, ["b", "a", "c"]), ranks(spark, ["a", "b"])).collect()}
    assert back == {x["chunk_id"]: x["rrf"] for x in got}
    assert got[2]["dense_rank"] is None


def test_pool_rank_cap_final_gate(spark):
    fused = r.fuse(ranks(spark, ["a", "b", "c", "d", "e"]), ranks(spark, []))
    pinned = spark.createDataFrame([(1, "p"), (1, "b")], "query_id int, chunk_id string")
    required = spark.createDataFrame([(1, "z"), (1, "e")], "query_id int, chunk_id string")
    pool = r.candidate_pool(fused, pinned, required, 3)
    assert [x["chunk_id"] for x in pool.orderBy("pool_pos").collect()] == ["b", "p", "a", "c", "e", "z"]
    score = F.expr("element_at(map('a', 0.9D, 'b', 0.1D, 'c', 0.9D, 'e', 0.2D, 'p', 0.05D, 'z', 0.01D), chunk_id)")
    x = r.ranked(pool.withColumn("score", score))
    assert [y["chunk_id"] for y in x.orderBy("order").collect()] == ["b", "p", "a", "c", "e", "z"]
    hits = r.final(r.cap_class(x, F.col("chunk_id").isin("a", "c", "e"), 1), 2)
    assert [(y["chunk_id"], y["hit_rank"]) for y in hits.orderBy("hit_rank").collect()] == [("b", 1), ("p", 2), ("e", 3), ("z", 4)]
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    gate = {y["query_id"]: (y["top_score"], y["has_evidence"]) for y in r.evidence(queries, hits).collect()}
    assert gate == {1: (0.1, False), 2: (0.0, False)}  # the pinned first hit decides, though others score 0.9
    cases = spark.createDataFrame([(2, "x", 0.3, 1)], "query_id int, case_id string, score double, case_rank int")
    assert {y["query_id"]: y["has_evidence"] for y in r.evidence(queries, hits, cases).collect()} == {1: False, 2: True}


def test_dense_top_equals_brute_force(spark):
    random.seed(1)
    v = [(i, [random.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None)]
    x = spark.createDataFrame(v, "chunk_id int, vector array<float>")
    q = x.where("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    got = {(y["query_id"], y["rank"]): y["chunk_id"] for y in r.dense_top(q, x, 7, blocks=3).collect()}
    cos = lambda a, b: sum(p * s for p, s in zip(a, b)) / (sum(p * p for p in a) ** 0.5 * sum(s * s for s in b) ** 0.5)
    for i in range(6):
        want = sorted(range(60), key=lambda j: (-cos(v[i][1], v[j][1]), j))[:7]
        assert [got[i, k] for k in range(1, 8)] == want


def test_sparse_top_ties_by_id_descending(spark):
    q = spark.createDataFrame([(1, "t", 2.0), (1, "u", 1.0)], "query_id int, token string, weight double")
    p = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 1.0), ("c", "x", 9.0), ("d", "u", 0.0)], "chunk_id string, token string, weight double")
    assert [(x["chunk_id"], x["score"]) for x in r.sparse_top(q, p).orderBy("rank").collect()] == [("b", 2.0), ("a", 2.0)]


QUERIES = [(1, "跑分会洗钱吗"), (2, "反洗钱部门有哪些"), (3, "usdt 换汇"), (4, "刑法第一百九十一条和第三百一十二条"), (5, "无关")]


def test_expand_required_pinned(spark):
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = {x["query_id"]: x["expanded"] for x in enrich.expand(q, rules.glossary(spark)).collect()}
    assert got[5] == "无关" and got[1].startswith("跑分会洗钱吗（相关概念：帮助信息网络犯罪活动罪")
    assert got[3] == "usdt 换汇（相关概念：个人购汇 年度便利化额度 等值5万美元；虚拟货币 虚拟货币交易炒作 非法金融活动）"
    law = rules.CRIMINAL_LAW
    chunks = spark.createDataFrame([("L191", law, "第一百九十一条"), ("L312", law, "第三百一十二条"), ("X191", "别的法", "第一百九十一条")], "chunk_id string, doc_title string, article string")
    assert {tuple(x) for x in enrich.required_chunks(q, rules.required(spark), chunks).collect()} == {(1, "L191"), (1, "L312")}
    assert {tuple(x) for x in enrich.pinned_chunks(q, chunks).collect()} == {(4, "L191"), (4, "L312")}


def test_definitions(spark):
    rows = [("c0", "第一条 本办法所称受益所有人，是指最终拥有的自然人。", 0), ("c1", "应当识别受益所有人。", 1)] + [(f"c{i}", "其他规定。", i) for i in range(2, 12)] + [("c12", "第九条 公司的高管是指经理。", 12)]
    chunks = spark.createDataFrame([("d", *x) for x in rows], "doc_id string, chunk_id string, text string, pos int")
    terms = enrich.definition_terms(chunks)
    assert {(x["chunk_id"], x["term"]) for x in terms.collect()} == {("c0", "受益所有人"), ("c12", "高管")}
    hits = spark.createDataFrame([(1, "c1", 1), (2, "c0", 1)], "query_id int, chunk_id string, hit_rank int")
    assert [tuple(x) for x in enrich.attach_definitions(hits, terms, chunks).collect()] == [(1, "c0", 1)]


def test_cases(spark):
    rows = [(0, "案例1 甲案·关键词", "案例1 甲案｜关键词\n【关键词】洗钱 、地下钱庄，钱\n【基本案情】某人", 2, 3), (1, "案例1 甲案·典型意义", "案例1 甲案｜典型意义\n一、典型意义 重大\n续", 3, 4)]
    x = spark.createDataFrame([("D", "汇编", "case", 1, *y) for y in rows], "doc_id string, doc_title string, kind string, article_no int, pos int, article string, text string, page_start int, page_end int")
    c = enrich.cases(x).first()
    assert (c["case_id"], c["title"], c["citation"]) == ("D#1", "案例1 甲案", "《汇编》 案例1 甲案 第2-4页")
    assert c["sections"] == {"关键词": "洗钱 、地下钱庄，钱", "基本案情": "某人", "典型意义": "重大\n续"} and c["keywords"] == ["洗钱", "地下钱庄"]
    queries = spark.createDataFrame([(1, "地下钱庄怎么罚"), (2, "别的")], "query_id int, text string")
    fused = spark.createDataFrame([(q, f"k{i}", i) for q in (1, 2) for i in (1, 2)], "query_id int, chunk_id string, fused_rank int")
    members = spark.createDataFrame([("k1", "D#1", 0.3), ("k2", "D#1", 0.3)], "chunk_id string, case_id string, s double")
    got = r.case_matches(queries, fused, members, enrich.cases(x), F.col("s")).collect()
    assert [(g["query_id"], g["chunk_id"], g["matched"]) for g in got] == [(1, "k1", ["地下钱庄"])]
