"""Rankings against brute force where every query meets every chunk: what leaves the tasks is bounded, ties and odd rows are as before."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from provenant.functions import shingles, text
from provenant.operators import dedupe, retrieve, scoring


def test_products_leave_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [["the", *(f"w{x}" for x in rng.zipf(1.5, 6) % 30)] for _ in range(2000)]
    chunks = spark.createDataFrame([(i, None if i % 50 == 7 else i % 3 == 0, None if i % 40 == 3 else w) for i, w in enumerate(words)], "chunk_id long, side boolean, tokens array<string>").repartition(3)
    asked = [(q, t, q % 4 + 1) for q in range(40) for t in {"the", f"w{q % 30}", "absent"}]
    queries = spark.createDataFrame(asked, "query_id long, token string, weight long")
    want = {}
    for q in range(40):
        mine = {t: w for i, t, w in asked if i == q}
        for side in (False, True):
            score = {i: sum(mine.get(t, 0) for t in w) for i, w in enumerate(words) if i % 40 != 3 and i % 50 != 7 and (i % 3 == 0) == side}
            best = sorted((-s, -i) for i, s in score.items() if s > 0)[:5]
            want |= {(q, side, k): (-i, -s) for k, (s, i) in enumerate(best, 1)}
    for most in (retrieve.BROADCAST_TOKENS, 30):
        monkeypatch.setattr(retrieve, "BROADCAST_TOKENS", most)
        found = retrieve.product_top(queries, chunks, 5)
        assert {(r["query_id"], r["side"], r["rank"]): (r["chunk_id"], r["score"]) for r in found.collect()} == want
        assert dict(found.dtypes)["score"] == "bigint"
    table = queries.select("query_id", "token", F.col("weight").cast("double").alias("weight")).toArrow().combine_chunks()
    leave = retrieve._products(table, chunks, 5).count()
    assert leave < 40 * 2 * 5 * 3 * 2  # 80,000 pairs share a token


def test_cosines_leave_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(scoring, "CELLS", 500)
    data = [[float(y) for y in x] for x in rng.integers(-2, 3, (1500, 4))]  # most stand more than once: ties
    data = [(i, v) for i, v in enumerate(data)] + [(2000, [0.0] * 4), (2001, None), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0])]
    v = spark.createDataFrame(data, "chunk_id long, vector array<float>").repartition(2)
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    sound = {i: np.array(x) for i, x in data if i < 1500 and any(x)}

    def cosine(a, b):
        dot = lambda x, y: sum(float(p) * float(s) for p, s in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    got = retrieve.dense_top(q, v, 9).collect()
    for i in (x for x in sound if x % 20 == 0):
        want = sorted((-cosine(sound[i], x), j) for j, x in sound.items())[:9]
        assert [(-r["score"], r["chunk_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want
    part = q.where("query_id < 1500").select("query_id", F.col("vector").cast("array<double>").alias("_q")).where("exists(_q, x -> x <> 0)").toArrow().combine_chunks()
    whole = v.where("chunk_id < 1500").select("chunk_id", F.col("vector").cast("array<double>").alias("_v")).where("exists(_v, x -> x <> 0)")
    assert retrieve.cosines(part, whole, 9).count() <= part.num_rows * 9 * 2


def test_few_items_meet_texts_as_sets_do(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("abcdefgh 𝒳"), 400))
    cut = lambda: base[rng.integers(0, 60) : rng.integers(100, 400)]
    docs = spark.createDataFrame([(i, cut()) for i in range(60)] + [(90, None), (91, "abc"), (92, base[5:30])], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", cut()) for i in range(20)] + [("none", None), ("short", base[8:24])], "item_id string, text string")
    rows = lambda x: sorted(tuple(r) for r in x.select("a", "b", "shared", "sim").collect())
    want = rows(dedupe.containment_pairs(dedupe.shingle_sets(docs), dedupe.shingle_sets(items, key="item_id"), other="item_id"))
    for most in (retrieve.BROADCAST_TOKENS, 900):
        monkeypatch.setattr(retrieve, "BROADCAST_TOKENS", most)
        found = dedupe.contained_texts(docs, items)
        assert rows(found) == want and len(want) > 100
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # no shingle is shuffled
    counted = {r[0]: r[1] for r in shingles.with_shingles(docs, sets=False).collect()}
    assert counted == {r[0]: r[1] for r in docs.select("doc_id", F.size(text.char_shingles(F.col("text")))).collect()}
