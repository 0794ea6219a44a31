"""The registered queries on a small folder of odd tables: columns, types, and rows by brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenant.llm import decontaminate, langid, licenses, quality, queries

from .test_operators import ODD, WORD, base_spans, lower, prose, removed, targets

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = {
    "op1_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_token_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_repeats": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_license_scan": "doc_id bigint",
    "op10_ngram_join": "doc_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [prose(rng, n, 200) for n in (3, 13, 30)]
    passage, notice = prose(rng, 140), licenses.TEMPLATES[1][1]
    sounds = {"aa": "ka lo mi tu".split(), "bb": "schw ein er ung".split()}
    docs = []
    for i in range(90):
        lang = rng.choice(["aa", "bb"])
        body = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90)))
        extra = [items[i // 9 % 3] if i % 9 == 0 else "", passage if i % 8 == 0 else "", f"password = {i:014d}ab" if i % 7 == 0 else "", f"\n{notice}\n" if i % 10 == 0 else ""]
        text = " ".join([body.capitalize() + ".", *extra, body[:80]])
        docs.append((i, text.upper().replace(" ", "!! ") if i % 6 == 5 else text, lang, rng.choice(["a", "b", "b", None]), i))
    docs += [(200 + i, t, None, "odd", None) for i, t in enumerate(ODD)] + [(300, docs[1][1], "aa", "a", 1), (301, docs[1][1] + " tail", "bb", None, 1), (302, docs[2][1].upper(), "aa", "b", 1)]
    vectors = np.random.default_rng(22).normal(size=(8, 6))
    embeddings = [(i, (vectors[i % 8] + 0.05 * np.random.default_rng(i).normal(size=6)).tolist(), i % 2 if i % 11 else None) for i in range(120)] + [(500, None, 0), (501, [0.0] * 6, 0), (502, [math.nan] * 6, 1), (503, embeddings_like(vectors[0]), 0)]
    folder = str(tmp_path_factory.mktemp("registered"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save([*enumerate(items), (9, None), (10, "")], "item_id long, text string", "benchmark")
    save([(i, int(i % 6 != 5), 0) for i in range(0, 90, 2)] + [(1, 1, 0), (5, 0, 0), (11, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int", "labels")
    save([(i // 6, i % 6, ["user", "assistant"][i % 2], f"Line {i}.") for i in range(60)], "conv_id long, turn long, role string, text string", "conversations")
    save(embeddings, "vec_id long, embedding array<float>, label int", "embeddings")
    return folder, {r[0]: r for r in docs}, items, embeddings


def embeddings_like(v):
    return [float(x) for x in v]


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: (df, df.collect()) for name, f in queries.queries().items() for df in [f(spark, tables[0])]}


def test_columns(results):
    for name, (df, rows) in results.items():
        want = [tuple(c.split(" ")) for c in COLUMNS[name].split(", ")]
        assert df.dtypes[: len(want)] == want, name
        assert len(rows) == {"op6_near_vectors": 124, "op13_conversation_repair": 10}.get(name, 100), name
        assert len({r[0] for r in rows}) == len(rows)


def test_mixing(results, tables):
    docs, rows = tables[1], results["op1_mix_sources"][1]
    order = ["a", "b", "odd", None]
    size = {i: len(SPACED.findall(t or "")) for i, t, *_ in docs.values()}
    sizes = [sum(size[d[0]] for d in docs.values() if d[3] == s) for s in order]
    want = dict(zip(order, targets(sizes, (1, 2, 3), 3), strict=True))
    for s, total in zip(order, sizes, strict=True):
        mine = [r for r in rows if docs[r["doc_id"]][3] == s]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == total and math.isclose(r["target"], want[s], abs_tol=1e-6) and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.5
    assert all((r["taken"] > 0) == bool(r["shards"]) == (r["place"] is not None) for r in rows)


def test_quality_and_language_by_rows_of_their_own(spark, results, tables):
    """Scores don't depend on labels, languages, sources, ids or other rows: each text by itself has the same."""
    folder, docs, *_ = tables
    d = queries.table(spark, folder, "documents")
    model = quality.fit(d.select("doc_id", "text"), queries.table(spark, folder, "labels"), ~queries.held_out())
    for r in results["op2_quality"][1]:
        data = (docs[r["doc_id"]][1] or "").encode()
        alone = float(model.score(quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0])
        assert math.isclose(r["score"], alone, abs_tol=1e-9) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [(r["predicted"] == int(r["doc_id"] % 6 != 5)) for r in results["op2_quality"][1] if r["doc_id"] < 90]
    assert sum(right) >= 85 and 0.5 < model.prior < 0.99
    classifier = langid.Classifier(langid.learn_dictionaries(d, ~queries.held_out()))
    for r in results["op5_language"][1]:
        text = docs[r["doc_id"]][1]
        lang, score, _ = classifier.predict(text)
        assert (r["lang_pred"], r["score"]) == (lang, score) and (lang == "und") == (not any(map(str.isalpha, text or "")))
    known = [r["lang_pred"] == docs[r["doc_id"]][2] for r in results["op5_language"][1] if r["doc_id"] < 90 and r["held_out"]]
    assert sum(known) >= 0.9 * len(known)


def test_tokens(results, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(results["op3_token_records"][1], key=lambda r: r["doc_id"]):
        ids = np.array([*plain.encode(tables[1][r["doc_id"]][1] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_secrets(results, tables):
    for r in results["op4_secret_scan"][1]:
        spans = base_spans(tables[1][r["doc_id"]][1])
        kinds = Counter(s[2] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))
    assert sum(r["n_assign"] for r in results["op4_secret_scan"][1]) > 8


def linked(keys, link):
    root = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            root[a] = min([root[a], *(root[b] for b in keys if link(a, b))])
    return root


def test_vectors(results, tables):
    data = {i: (np.array(v, np.float32).astype(float), label) for i, v, label in tables[3] if v is not None and label is not None and np.isfinite(v).all() and np.any(v)}
    link = lambda a, b: a != b and a in data and b in data and data[a][1] == data[b][1] and data[a][0] @ data[b][0] / np.linalg.norm(data[a][0]) / np.linalg.norm(data[b][0]) >= 0.98
    keys = [i for i, *_ in tables[3]]
    table = {(a, b) for a in keys for b in keys if link(a, b)}
    root = linked(keys, lambda a, b: (a, b) in table)
    assert len(table) > 100
    for r in results["op6_near_vectors"][1]:
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum((r["vec_id"], b) in table for b in keys), root[r["vec_id"]], root[r["vec_id"]] == r["vec_id"])


def test_repeats(results, tables):
    keys = sorted(tables[1])
    for i, spans in zip(keys, removed([tables[1][i][1] for i in keys], 400), strict=True):
        r = next(r for r in results["op7_repeats"][1] if r["doc_id"] == i)
        data, at, kept = (tables[1][i][1] or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        kept += data[at:]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), len(data) - len(kept), len(spans), sha(kept)) and r["removed"] == ",".join(f"{a}:{b}" for a, b in spans)
    assert sum(r["shares_passage"] for r in results["op7_repeats"][1]) >= 12


def test_decontaminate(results, tables):
    windows = {}
    for k, item in enumerate(tables[2]):
        w = WORD.findall(lower(item))
        for i in range(len(w) - min(13, len(w)) + 1):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(k))
    for r in results["op8_decontaminate"][1]:
        w = WORD.findall(lower(tables[1][r["doc_id"]][1]))
        hit, found = set(), set()
        for i in range(len(w)):
            for m in {len(x) for x in windows}:
                if ids := windows.get(tuple(w[i : i + m])) if i + m <= len(w) else None:
                    hit.update(range(i, i + m))
                    found |= ids
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    assert sum(r["contaminated"] for r in results["op8_decontaminate"][1]) >= 5
    assert decontaminate.WINDOW == 13


def test_licenses(results, tables):
    """Every wording that stands in a text word by word is found, as the longest of those that overlap."""
    words = lambda t: [(m[0].lower(), m.start(), m.end()) for m in licenses.WORD.finditer(t or "")]
    wordings = [(name, [w for w, _, _ in words(t)]) for name, t in licenses.TEMPLATES]
    for r in results["op9_license_scan"][1]:
        text = words(tables[1][r["doc_id"]][1])
        exact = [(name, text[i][1], text[i + len(want) - 1][2]) for name, want in wordings for i in range(len(text) - len(want) + 1) if [w for w, _, _ in text[i : i + len(want)]] == want]
        longest = [x for x in exact if not any(a <= x[1] and x[2] <= b and (a, b) != x[1:] for _, a, b in exact)]
        got = [tuple(p.split(":")) for p in r["passages"].split(",") if p]
        assert {(name, str(a), str(b)) for name, a, b in longest} == {p[:3] for p in got if p[3] == "0"}
        assert r["n_licenses"] == len(got)
    assert sum(r["n_licenses"] for r in results["op9_license_scan"][1]) >= 8


def test_near_copies(results, tables):
    sets = {}
    for i, t, *_ in tables[1].values():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    keys = sorted(sets)
    table = {(a, b) for a in keys for b in keys if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    root = linked(keys, lambda a, b: (a, b) in table)
    for r in results["op10_ngram_join"][1]:
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum((r["doc_id"], b) in table for b in keys), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert len(table) >= 6


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        queries.table(spark, tables[0], name).where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    for f in queries.queries().values():
        assert f(spark, str(tmp_path)).count() == 0
