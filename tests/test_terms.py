"""Terms of documents in their chunks, by one automaton for each document."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from provenant.operators import enrich


def test_terms_by_brute_force(spark):
    """Terms within others, overlapping, of other documents; null texts; more terms than an automaton takes, a document with most chunks."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab客户") for _ in range(n))
    terms = {d: {word(rng.randint(2, 5)) for _ in range(40)} for d in ("x", "y", "z")}
    texts = [(d, word(rng.randint(0, 60))) for d in ("x", *"y" * 9, "w") for _ in range(15)] + [("z", None), ("x", "")]
    t = spark.createDataFrame(texts, "doc string, text string").repartition(3)
    k = spark.createDataFrame([(d, x) for d, each in terms.items() for x in each], "doc string, term string")
    want = sorted((d, x) for d, text in texts if text for x in terms.get(d, ()) if x in text)
    for at_once in (enrich.TERMS_AT_ONCE, 7):
        assert sorted(map(tuple, enrich.held_terms(t, k, at_once=at_once).collect())) == want and len(want) > 500
    assert enrich.held_terms(t, k.where("false")).count() == 0


def test_definitions_grow_with_what_hits_hold(spark, monkeypatch):
    """A query with many hits in a document with many definitions: as by brute force, and no table of hits times definitions is made."""
    rng = random.Random(6)
    n = 400
    word = lambda: "".join(rng.choice("abc") for _ in range(4))
    texts = {i: " ".join(word() for _ in range(12)) for i in range(n)}
    defines = {(i % 2, i, w) for i, t in texts.items() for w in t.split()[:2]}
    hits = {(q, c): r for q in (1, 2, 3) for r, c in enumerate(rng.sample(range(n), (300, 20, 1)[q - 1]), 1)}
    best: dict = {}
    for (q, c), r in hits.items():
        for d, at, w in defines:
            if d == c % 2 and w in texts[c] and (q, at) not in hits:
                best[q, at] = min(best.get((q, at), (r, at)), (r, at))
    want = sorted((q, at, k) for q in (1, 2, 3) for k, (_, at) in enumerate(sorted((v, at) for (p, at), v in best.items() if p == q)[:2], 1))
    terms = spark.createDataFrame([*defines, *list(defines)[:50]], "doc_id int, chunk_id int, term string")
    chunks = spark.createDataFrame([(i, i % 2, t, i) for i, t in texts.items()], "chunk_id int, doc_id int, text string, pos int")
    table = spark.createDataFrame([(q, c, r) for (q, c), r in hits.items()], "query_id int, chunk_id int, hit_rank int")
    found = enrich.attach_definitions(table, terms, chunks)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan
    assert enrich.attach_definitions(table.where(F.lit(False)), terms, chunks).count() == 0
