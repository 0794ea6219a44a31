"""The pipeline's stages on small tables, each against its rule by brute force."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as p
from provenant.llm import quality, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join("w" + str(rng.randint(0, 900)) for _ in range(n)).capitalize() + "."
    items = [prose(20) for _ in range(3)]
    texts = [prose(rng.randint(30, 80)) for _ in range(150)]
    texts += [t + " " + items[0] for t in texts[:5]] + [texts[9], texts[9], texts[10] + " tail"]
    junk = [prose(40).upper().replace(" ", "!! ") for _ in range(30)]
    rows = [(i, t, "en", rng.choice(["a", "b", "b", "c", None]), None if t is None else len(t), "x") for i, t in enumerate([*texts, *junk, None, "", "word"])]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _taken string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(texts) + len(junk)) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5 and "quality" in names[0] and "Jaccard" in names[1]
    rows = {}
    for name, f in p.STAGES:
        docs = p.stage(f(spark, docs, sf_dir), "test")
        rows[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
    first, near, clean, mixed, tokens = (rows[n] for n in names)
    # quality: what the scores say, and texts without words stay
    d = queries.table(spark, sf_dir, "documents")
    model = quality.fit(d, queries.table(spark, sf_dir, "labels"), ~queries.held_out())
    scores = {r["doc_id"]: r["_score"] for r in quality.score(d, model).collect()}
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in d.collect() if scores[r["doc_id"]] >= 0.3 or not (r["text"] or "").split()}
    assert sum(r["doc_id"] < 158 for r in first) >= 155 and sum(158 <= r["doc_id"] < 188 for r in first) <= 2
    # near copies: one of each group
    words = lambda t: WORD.findall((t or "").lower())
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := words(r["text"])) else set() for r in first}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    assert sorted(r["doc_id"] for r in near) == sorted({r for r in root.values()})
    # decontamination
    assert {r["doc_id"] for r in near} - {r["doc_id"] for r in clean} == {r["doc_id"] for r in near if 150 <= r["doc_id"] < 155}
    # mixing: at most three copies, none without words; sources near their targets is tested with the operator
    copies = [r["doc_id"] for r in mixed]
    assert copies and max(map(copies.count, set(copies))) <= 3 and all(words(r["text"]) for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in clean}
    # tokens: a record for each row
    assert sorted(r["doc_id"] for r in tokens) == sorted(copies)
    assert sorted(r["start"] for r in tokens)[0] == 0
    run = p.run(spark, sf_dir).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, tokens))


def test_empty_tables(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").where("false")
    for _, f in p.STAGES:
        docs = f(spark, docs, sf_dir)
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
