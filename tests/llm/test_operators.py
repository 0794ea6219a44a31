"""The operators against brute force, round trips and held-out accuracy, with null, empty, long, repeated and clashing rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from provenant.llm import components, decontaminate, langid, licenses, mixing, ngrams, quality, queries, repeats, secrets, tokens, vectors, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, words=400):
    return " ".join("w" + str(int(words * rng.random() ** 2)) for _ in range(n))


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


ODD = [None, "", "   \n", "...", "é", "x" * 200_000, "Aa " * 30_000]


# ---- 1


def targets(sizes, weights, most):
    """Resharing by the letter."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        share = {i: left * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i] + 1e-9}
        for i in over or open_:
            out[i] = most * sizes[i] if over else share[i]
            left -= out[i]
        open_ -= over or open_
    return out


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "c", None]), i) for i in range(300)] + [(400, None, "a", 1), (401, " ", "zero", 1), (7, "dup dup", "a", 1), (7, "dup dup", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken long")
    mixed = mixing.mix(docs, keep_undrawn=True, block_words=16).cache()
    got = mixed.collect()
    order = ["a", "b", "c", "zero", None]
    sizes = [sum(len((t or "").split()) for _, t, s, _ in rows if s == o) for o in order]
    want = dict(zip(order, targets(sizes, (1, 2, 3), 3), strict=True))
    for s, size in zip(order, sizes, strict=True):
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["_target"], want[s], abs_tol=1e-6) and r["_source_size"] == size for r in mine)
        assert sum(r["_taken"] for r in mine) == round(want[s])
    per = Counter()
    for r in got:
        per[r["doc_id"], r["text"]] += r["_taken"]
    assert all(n <= 3 * len((t or "").split()) * (2 if i == 7 else 1) for (i, t), n in per.items())
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    again = mixing.mix(docs, keep_undrawn=True, block_words=16).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.shuffled(mixed.where("_copy is not null")).count() == sum(r["_copy"] is not None for r in got)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix(docs.where("doc_id > 399")).count() == 0
    # by block: each shard has as many words of a source as the blocks that the tree dealt it
    pieces = mixing.mix(docs, parts=True, block_words=16).collect()
    assert sum(r["_taken"] for r in pieces) == sum(r["_taken"] for r in got) and all(0 < r["_taken"] <= 16 for r in pieces)
    shards = {(r["doc_id"], r["text"], r["_copy"]): r["_shard"] for r in got if r["doc_id"] != 7}
    assert len(set(shards.values())) > 1 and {k: s for k, s in shards.items() if s is not None}.items() <= {(r["doc_id"], r["text"], r["_copy"]): r["_shard"] for r in reversed(sorted(pieces, key=lambda r: r["_order"])) if r["_shard"] == shards.get((r["doc_id"], r["text"], r["_copy"]))}.items()


def test_draws_are_disjoint_and_follow_the_tree(spark):
    sources = spark.createDataFrame([(0, 1000), (1, 333), (2, 0), (3, 7)], "sid int, quota long")
    drawn = mixing.draws(sources, 10, 3, 5).collect()
    blocks = {0: 100, 1: 34, 3: 1}
    assert sorted((r["sid"], r["block"]) for r in drawn) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    tree = mixing.splitting_tree(spark.createDataFrame([(s, n) for s, n in blocks.items()], "sid int, k long"), 3, 5).collect()
    assert Counter((r["sid"], r["shard"]) for r in drawn) == {(r["sid"], r["shard"]): r["k"] for r in tree}
    first = [r["block"] for r in drawn if r["sid"] == 0 and r["shard"] == 0]
    assert sorted(first) != list(range(min(first), max(first) + 1))  # permuted


def test_splitting_tree_is_hypergeometric(spark):
    counts = spark.createDataFrame([(0, 40), (1, 25), (2, 3)], "sid int, k long")
    first = []
    for seed in range(40):
        rows = mixing.splitting_tree(counts, 2, seed).collect()
        by = Counter()
        for r in rows:
            by[r["sid"]] += r["k"]
        assert by == {0: 40, 1: 25, 2: 3}
        size = Counter()
        for r in rows:
            size[r["shard"]] += r["k"]
        assert sorted(size.values()) == [17, 17, 17, 17]
        first.append(sum(r["k"] for r in rows if r["shard"] == 0 and r["sid"] == 0))
    assert abs(np.mean(first) - 10) < 1.2 and 0.5 < np.var(first) < 8  # 17 of 68, 40 of one kind: mean 10, variance 3.1


# ---- 2


def test_quality(spark):
    rng = random.Random(2)
    good = [prose(rng, 60).capitalize() + "." for _ in range(150)]
    bad = [prose(rng, 60).upper().replace(" ", "!! ") for _ in range(30)] + ["same " * 80 for _ in range(30)]
    texts = good + bad
    docs = frame(spark, texts + ODD)
    rows = [(i, int(i < len(good))) for i in range(len(texts)) if i % 2]
    labels = spark.createDataFrame([*rows, (None, 1), (3, None), (10**9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, ~queries.held_out())
    got = {r["doc_id"]: r["_score"] for r in quality.score(docs.withColumn("_score", F.lit("old")), model).collect()}
    assert len(got) == len(texts) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0 and (got[i] >= 0.3) != (i < len(good))]
    assert len(wrong) <= 2
    assert quality.fit(docs, labels.where("quality = 0"), F.lit(True)) is None and quality.fit(docs.where("false"), labels, F.lit(True)) is None
    assert {r["_score"] for r in quality.score(docs.limit(3), None).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1.5, 1, (400, 1)), rng.normal(-1.5, 1, (400, 1))])
    x = np.hstack([x, np.ones_like(x)])
    w = quality.nnpu(x[:200], x, 0.5)
    assert ((x @ w > 0) == (np.arange(800) < 400)).mean() > 0.9


# ---- 3


def test_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(3)
    texts = [prose(rng, 30) + rng.choice([" it's\tok", " x　y", " <|endoftext|>a", " é É", "\n\nz  z"]) for _ in range(40)] + [t[:5000] if t else t for t in ODD]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "null key"), (50, "again"), (50, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    uri = f"file://{tmp_path}/t"
    manifest = tokens.write_tokens(docs, uri, path, end_id=2, shard_bytes=500)
    got = tokens.read_tokens(manifest, uri, tokens.ids_crc32, "ids_crc32 long").orderBy("start").collect()
    plain = Tokenizer.from_file(path)
    at = 0
    for (key, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    fs = pafs.LocalFileSystem()
    shard = manifest.orderBy("shard").first()
    with fs.open_input_stream(f"{tmp_path}/t/{shard['shard']}.rec") as s:
        payloads = list(tokens.records(s))
    assert [tokens.read_record(fs, f"{tmp_path}/t/{shard['shard']}.rec", k) for k in range(shard["records"])] == payloads
    data = bytearray((tmp_path / "t" / f"{shard['shard']}.rec").read_bytes())
    data[20] ^= 1
    (tmp_path / "bad.rec").write_bytes(data)
    with pytest.raises(ValueError), fs.open_input_stream(f"{tmp_path}/bad.rec") as s:
        list(tokens.records(s))
    assert tokens.token_output(docs.where("false"), path).count() == 0
    named = tokens.token_output(docs.select(F.concat(F.lit("é#"), "doc_id").alias("doc_id"), "text"), path).collect()
    assert sorted(r["key"] or "" for r in named) == sorted("é#" + str(k) if k is not None else "" for k, _ in rows)
    dated = tokens.token_output(docs.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("doc_id"), "text"), path)
    assert dict(dated.dtypes)["key"] == "date" and dated.where("key is null").count() == 1
    assert tokens.unpacked(tokens.packed(None, np.arange(3, dtype="<u2")))[0] is None and tokens.unpacked(tokens.packed("ß", np.arange(3, dtype="<u4")))[1].tolist() == [0, 1, 2]


def test_pieces_have_the_ids_of_the_whole(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(words, "PART", 256)
    words._powers.cache_clear()
    monkeypatch.setattr(tokens, "PORTION", 30)
    coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    other = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.by_piece and coder.model is not None and not other.by_piece and other.model is None
    letters = "abcxyzABZéÉàÀñßẞøæœÆΣσςΑİıǅǆЖжあ語한ﬁªºʼnJ\u030cE\u0301i\u0307"
    rng = random.Random(13)
    marks = ["it's", " ", "\n", ".", ",", "...", "'s", "A", "bc", "É", "é", "\u0301", "1", "23", "語", "  ", "\t", "<|endoftext|>", "!", "?", "ΑΣ", "İ", "J\u030c", "a.", "b,", "x!?", "-", "_"]
    for k in range(700):
        texts = ["".join(rng.choice(marks if k < 400 else letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.choice([1, 3]))]
        data = [t.encode() for t in texts]
        ids, at = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    words._powers.cache_clear()


# ---- 4


def base_spans(text):
    out = []
    for rank, r in enumerate(secrets.BASE):
        pattern = r.regex.replace("(?i:", "(?ai:")
        out += [(m.start(), rank, r.kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(4)
    parts = ["password=abcdefghijkl", 'PassWd": "ABC123_./=+-zz"', "api_key : shorty", "apikey=123456789012", "token =  'aaaaaaaaaaaaaa", "AKIA" + "Z9" * 7, "AKIAAKIA" + "Q" * 9, "deadbeef" * 2, "0" * 15, "0" * 16, "secrets=abcdefghijklm", "😀é", "x y", "password=password=abcdefghijklmn"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "-"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    docs = frame(spark, texts + ODD).unionByName(spark.createDataFrame([(None, "secret=abcdefghijkl"), (1, texts[1])], "doc_id long, text string"))
    docs = docs.withColumn("_spans", F.lit(1)).withColumn("bucket", F.lit(2))
    got = secrets.scan(docs).collect()
    assert len(got) == len(texts) + len(ODD) + 2
    for r in got:
        mine = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["_spans"]]
        assert [s for s in mine if s[1] < len(secrets.BASE)] == base_spans(r["text"])
    assert secrets.scan(docs.where("false")).count() == 0
    pem = secrets.scan(frame(spark, ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9])).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["_spans"]] for r in pem] == [["pem"], ["github"]]


def drawn(tree, rng, folded=False):
    """A random match of a parsed regular expression."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += rng.choice([chr(arg).lower(), chr(arg).upper()]) if folded else chr(arg)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(drawn(inner, rng, folded) for _ in range(rng.randint(low, min(int(high), low + 3))))
        elif name == "ANY":
            out += rng.choice("ab. ")
        elif name == "SUBPATTERN":
            out += drawn(arg[3], rng, folded or bool(arg[1] & re.IGNORECASE))
        elif name == "BRANCH":
            out += drawn(rng.choice(arg[1]), rng, folded)
        else:
            raise NotImplementedError(name)
    return out


def test_every_match_of_a_rule_meets_its_query():
    rng = random.Random(11)
    more = [secrets.Rule(str(i), r) for i, r in enumerate((r"(abc|abd)?xyz", r"(?:key|id)-[0-9]{2,}(end|fin)+", r"a.bcd[efg]{1,2}h", r"(foo|ba[rz]q)s?=", r"x{3}y?z{4,9}", r"[ab]", r"(abc|d)"))]
    for r in (*secrets.RULES, *more):
        query = secrets.mandatory(re._parser.parse(r.regex))
        assert all(len(x) >= 3 for strings in query for x in strings)
        for _ in range(2000):
            m = drawn(re._parser.parse(r.regex), rng)
            assert re.search(r.regex, m) and all(any(x in m.lower() for x in strings) for strings in query)
    queries_of = {r.kind: r.query() for r in secrets.RULES}
    assert {k for k, q in queries_of.items() if not q} == {"hex"} and len(queries_of["pem"]) == 2 and len(queries_of["assign"][0]) == 6
    assert secrets.Rule("x", "ab").query() == [] == secrets.Rule("x", "(abc|d)").query()  # no mandatory trigram: scans fully


# ---- 5


def test_language(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schw", "ein", "er", "ung"], "cc": ["ção", "lh", "os", "que"]}
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(80))
    rows = [(i, make(syllables[lang]), lang) for i, lang in enumerate(rng.choices(list(syllables), k=150))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 345 ...", "bb"), (902, "", None), (903, "KA LO", None)], "doc_id long, text string, lang string")
    learned = langid.learn_dictionaries(docs, ~queries.held_out())
    got = {r["doc_id"]: r for r in langid.predict(docs.withColumn("_score", F.lit(0)), learned).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[i]["_lang"] == lang for i, _, lang in held)
    assert [got[i]["_lang"] for i in (900, 901, 902)] == [langid.UNKNOWN] * 3 and all(0 <= r["_score"] <= 1 for r in got.values())
    assert langid.predict(docs.limit(2), {}).first()["_lang"] == langid.UNKNOWN and langid.learn_dictionaries(docs.where("false"), F.lit(True)) == {}


def test_language_learns_from_whole_distinct_texts(spark):
    opening = "the same opening stands before every text " * 60
    long = [(i, opening + f"m{i}é " * 1500, "aa") for i in range(600)]
    copies = [(1000 + i, "copied " + f"c{i // 300}x " * 300, "bb") for i in range(300)] + [(2000 + i, f"d{i}x " * 300, "bb") for i in range(600)]
    docs = spark.createDataFrame([*long, *copies, (5000, "", "cc")], "doc_id long, text string, lang string")
    learned = langid.learn_dictionaries(docs, F.lit(True))
    assert {x: n for x, (_, n) in learned.items()} == {"aa": 600, "bb": 900, "cc": 1}
    assert all(len(d) <= langid.DICTIONARY_BYTES for d, _ in learned.values()) and len(learned["aa"][0]) > 0.9 * langid.DICTIONARY_BYTES
    assert len(set(re.findall(r"m\d+é", learned["aa"][0].decode(errors="ignore")))) > 150  # more than openings, of nearly all that are drawn
    assert learned["bb"][0].count(b"c0x") * 4 < 3 * langid.DICTIONARY_BYTES // 256  # copies are one text
    assert learned["cc"][0] == b"" and langid.predict(docs.limit(1), learned).count() == 1


def test_shares_fill_the_dictionary():
    for sizes in ([], [5], [1, 2, 300], [50] * 10, [1000, 1, 70, 70]):
        cap = langid.share(sizes, 200)
        assert sum(min(n, cap) for n in sizes) <= 200 and (cap >= max(sizes, default=0) or sum(min(n, cap + 1) for n in sizes) > 200)


# ---- 6


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = [(i, (centres[i % 12] + 0.09 * rng.normal(size=8)).tolist(), i % 3 if i % 7 else None) for i in range(300)]
    x += [(300 + i, centres[0].tolist(), 0) for i in range(40)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [math.nan] * 8, 0), (403, [1.0, None] + [0.0] * 6, 0), (404, [], 0), (405, [math.inf] * 8, 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (None, centres[1].tolist(), 1), (5, x[5][1], x[5][2])]
    rows = spark.createDataFrame(x, "vec_id long, embedding array<float>, label int").withColumn("_links", F.lit("old"))
    got = vectors.near_vectors(rows, block=16).collect()
    ok = lambda v: v and None not in v and all(map(math.isfinite, v)) and any(v)
    data = [(r["vec_id"], [np.float32(c) for c in r["embedding"]] if ok(r["embedding"]) else None, r["label"]) for r in got]
    u = [None if v is None else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in data]
    n = len(data)
    link = [[a != b and u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and data[a][2] is not None and data[a][2] == data[b][2] and float(u[a] @ u[b]) >= 0.98 for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[a], *(root[b] for b in range(n) if link[a][b])]) for a in range(n)]
        if new == root:
            break
        root = new
    for a in range(n):
        keys = [data[b][0] for b in range(n) if root[b] == root[a] and data[b][0] is not None]
        assert got[a]["_links"] == sum(link[a]) and got[a]["_component"] == (min(keys) if keys else None)
    assert sum(map(sum, link)) > 2000
    assert vectors.near_vectors(rows.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 7


def removed(texts, size):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\x01" * size
        out.append([(m.start(), m.end()) for m in re.finditer(b"\x01+", gone)])
    return out


def test_repeats(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [line(n) for n in (380, 450, 900, 1500)]
    texts = [line(rng.randint(0, 900)) + rng.choice(shared) + line(rng.randint(0, 900)) + rng.choice(["", rng.choice(shared)]) for _ in range(40)]
    texts += [texts[0], texts[0], "z" * 400, "y" * 399, "q" * 1200, line(100) + "q" * 405, *ODD[:5], "ab" * 700]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, texts[3]), (4, texts[4])], "doc_id long, text string")).withColumn("_kept", F.lit(1))
    whole = [*texts, texts[3], texts[4]]
    want = Counter((t, tuple(s)) for t, s in zip(whole, removed(whole, 400), strict=True))
    for group in (repeats.GROUP, 1):  # in tasks, and by the distributed way for large groups
        monkeypatch.setattr(repeats, "GROUP", group)
        got = repeats.remove_repeats(docs).collect()
        assert Counter((r["text"], tuple((s["start"], s["end"]) for s in r["_removed"])) for r in got) == want
        for r in got:
            data, at, kept = (r["text"] or "").encode(), 0, b""
            for s in r["_removed"]:
                kept, at = kept + data[at : s["start"]], s["end"]
            assert bytes(r["_kept"]) == kept + data[at:]
    assert repeats.remove_repeats(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, size=100)


@pytest.mark.parametrize("part", [1 << 18, 40])
def test_passages(spark, monkeypatch, part):
    monkeypatch.setattr(repeats, "PARSE_BYTES", part)
    rng = random.Random(18)
    shared = [prose(rng, n) for n in (50, 51, 52, 70, 200)]
    texts = [" ".join([prose(rng, rng.randint(0, 90)), shared[i % 5] if i < 25 else "", prose(rng, rng.randint(0, 60))]) for i in range(60)]
    texts += [shared[1].upper().replace(" ", ", "), prose(rng, 120), "two " * 300, *ODD[:5], "Aa " * 3000]
    twice = prose(rng, 60)
    texts += [twice + " . " + twice, texts[30], texts[30]]
    rows = [*enumerate(texts), (None, texts[40]), (41, texts[41])]  # the last is the same document again
    windows = {}
    for k, t in rows:
        w = WORD.findall(lower(t))
        for i in range(len(w) - 50):
            windows.setdefault(tuple(w[i : i + 51]), set()).add((k, t))
    want = {d for found in windows.values() if len(found) > 1 for d in found}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.passage_holders(docs).collect()
    hashes = {(r["_d"], r["_e"]): (r["doc_id"], r["text"]) for r in docs.withColumns(repeats.document(F.col("doc_id"), F.col("text"))).collect()}
    assert {hashes[r["_d"], r["_e"]] for r in got} == want and len(got) == len(want) and 20 < len(want) < 50
    assert repeats.passage_holders(docs.where("false")).count() == 0


# ---- 8


@pytest.mark.parametrize("block_bytes", [decontaminate.MAX_BLOCK_BYTES, 300])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(9)
    items = [prose(rng, n, 30) for n in (1, 2, 3, 12, 13, 14, 20, 40)] + [None, "", "...", "W1, w2; W3"]
    texts = [" ".join(rng.choice([prose(rng, 5, 30), rng.choice(items[4:8]), rng.choice(items[4:8]).upper().replace(" ", ", ")]) for _ in range(rng.randint(1, 8))) for _ in range(60)] + ODD
    docs = frame(spark, texts).withColumn("_found", F.lit(1))
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (None, items[6])], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, max_block_bytes=block_bytes).withColumn("c", decontaminate.is_contaminated()).collect()
    tagged = [(str(i), WORD.findall(lower(t))) for i, t in enumerate(items)] + [("", WORD.findall(lower(items[6])))]
    for r in got:
        w = WORD.findall(lower(r["text"]))
        hit, found = [False] * len(w), set()
        for i, words in tagged:
            m = min(13, len(words))
            windows = {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if m else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in windows:
                    hit[k : k + m] = [True] * m
                    found.add(i)
        spans = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if h else "." for h in hit))]
        assert (r["_found"]["n_words"], [(s["start"], s["end"]) for s in r["_found"]["spans"]], r["_found"]["items"]) == (len(w), spans, sorted(found))
        assert r["c"] == (sum(hit) > 0 and 20 * sum(hit) >= len(w))
    none = decontaminate.decontaminate(docs, bench.where("false"))
    assert none.where("size(_found.items) > 0").count() == 0 and decontaminate.decontaminate(docs.where("false"), bench).count() == 0


# ---- 9


def test_licenses(spark):
    mit = next(t for k, t in licenses.TEMPLATES if k == "MIT" and len(t) > 200)
    texts = {
        "One.\nReleased under the MIT License.": ["MIT"], "Licensed under the Apache License, Version 2.0.\nBye": ["Apache-2.0"], "Licensed under the Apache License, Version 9.0.": [],
        "x. " + mit.replace("sublicense", "sub-license"): ["MIT"], "We licensed the film.": [], "Licensed under CC BY-NC 4.0. All rights reserved.": ["CC-BY-NC-4.0", "LicenseRef-all-rights-reserved"], "permission to leave": [],
    }
    docs = frame(spark, [*texts, *ODD, "licen" * 20_000]).withColumn("_licenses", F.lit(1))
    got = {r["text"]: [x["license"] for x in r["_licenses"]] for r in licenses.scan(docs).collect()}
    assert {t: got[t] for t in texts} == texts and all(got[t] == [] for t in ODD)
    scanner = licenses.Scanner()
    for k, (_, t) in enumerate(licenses.TEMPLATES):  # every wording finds itself
        assert scanner.match(t)[0] == k or licenses.TEMPLATES[scanner.match(t)[0]][0] == licenses.TEMPLATES[k][0]
        assert scanner.match(t)[2] == []
    assert licenses.scan(docs.where("false")).count() == 0 and licenses.Scanner(()).scan("MIT License") == []


def test_licenses_wrapped_and_within_sentences():
    scanner = licenses.Scanner()

    def found(text):
        return [(x["license"], x["different"], text[x["start"] : x["end"]]) for x in scanner.scan(text)]

    for name, t in licenses.TEMPLATES:
        wording = t[: list(licenses.WORD.finditer(t))[-1].end()]
        for m in re.finditer(" ", wording):
            for gap in ("\n", "\n * ", "\r\n# "):
                wrapped = wording[: m.start()] + gap + wording[m.end() :]
                assert found(f"A line.\n{wrapped}. More of it.") == [(name, [], wrapped)]
        narrow = wording.replace(" ", "\n    // ")
        assert found(f"// {narrow}.\n") == [(name, [], narrow)]
        inside = wording[0].lower() + wording[1:]
        assert found(f"As far as we know, this small project here is {inside}, as others are.") == [(name, [], inside)]
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"
    assert [x[0] for x in found(mpl)] == ["MPL-2.0"]
    assert [x[0] for x in found("This project is licensed under the MIT License.")] == ["MIT"]
    assert found("No rights reserved.") == found("It has some rights reserved.") == [] and found("This is licensed under the\nApache License, Version 9.0.") == []


# ---- 10


def test_similarity_join(spark):
    rng = random.Random(10)
    base = [prose(rng, 120) for _ in range(6)]

    def edit(text):
        w = text.split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())[2:7]
        return " ".join(w)

    texts = [edit(rng.choice(base)) for _ in range(120)] + [base[0], base[0].upper(), base[0] + "!", "one two", "One, two.", *ODD, *ODD]
    rows = [*enumerate(texts), (None, base[1]), (3, texts[3]), (3, base[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_kept", F.lit(1)).withColumn("node", F.lit(2))
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    n = len(rows)
    link = [[a != b and bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[a], *(root[b] for b in range(n) if link[a][b])]) for a in range(n)]
        if new == root:
            break
        root = new
    want = Counter()
    for a, (key, text) in enumerate(rows):
        keys = [rows[b][0] for b in range(n) if root[b] == root[a] and rows[b][0] is not None]
        want[key, text, sum(link[a]), min(keys) if keys else None] += 1
    for block in (ngrams.BLOCK, 8):
        got = ngrams.similarity_join(docs, block=block).collect()
        assert Counter((r["doc_id"], r["text"], r["_links"], r["_component"]) for r in got) == want
        assert sum(r["_kept"] for r in got) == len(set(root)) and got[0]["node"] == 2
    assert sum(map(sum, link)) > 300
    assert ngrams.similarity_join(docs.where("false")).count() == 0


def test_pruning_keeps_the_threshold():
    least = ngrams.need(0.8)
    assert least == sorted(least) and least[-1] > 0.4 * ngrams.HASHES
    for n, m in zip(range(ngrams.CHUNK, ngrams.HASHES + 1, ngrams.CHUNK), least, strict=True):
        assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-6  # a pair at the threshold is all but never dropped


def test_pairs_at_the_threshold_are_linked(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    texts = []
    for k, (shared, united) in enumerate([(12, 15), (24, 30), (28, 35), (11, 14), (27, 34)]):
        texts += [words(f"t{k}x", united + 4), words(f"t{k}x", shared + 4)]
    got = {r["doc_id"]: (r["_links"], r["_component"], r["_kept"]) for r in ngrams.similarity_join(frame(spark, texts)).collect()}
    for i in (0, 2, 4):
        assert (got[i], got[i + 1]) == ((1, i, True), (1, i, False))
    for i in (6, 8):  # 11/14 and 27/34 are just below
        assert (got[i], got[i + 1]) == ((0, i, True), (0, i + 1, True))


def test_ties_at_the_threshold_of_every_size():
    for k in range(1, 2001):
        for shared, linked in ((4 * k, True), (4 * k - 1, False)):
            both = np.array([[5 * k, shared], [shared, shared]], np.float32)
            assert ngrams.reached(both, np.array([5 * k, shared]), 0.8)[0, 1] == linked


# ---- all


def test_words_in_parts_are_the_same(monkeypatch):
    rng = random.Random(14)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 90)] + ["", "...", "a" * 700, "Aa " * 200, "é b1 C", ""]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])

    def all_of():
        words._powers.cache_clear()
        w = words.Words(raw, offsets)
        x = [w.start, w.end, w.hash, w.first, w.whole(), ngrams.signatures(w), quality.features(raw, offsets)]
        return [*map(np.asarray, x), *ngrams.shingle_sets(w)], [w.text(i, 1) for i in range(len(w))], sorted(tuple(map(tuple, zip(*t, strict=True))) for t in repeats.all_triggers(np.tile(raw, 3), np.array([0, 3 * len(raw)]), repeats.of_bytes(), 200))

    whole, spelled, _ = all_of()
    assert spelled == [w.encode() for t in texts for w in WORD.findall(lower(t))]
    for module in (words, quality, ngrams):
        monkeypatch.setattr(module, "PART", 256)
    assert all(np.array_equal(a, b) for a, b in zip(all_of()[0], whole, strict=True))
    monkeypatch.undo()
    words._powers.cache_clear()


def test_triggers_of_parts_are_those_of_the_whole():
    rng = np.random.default_rng(15)
    raw = np.concatenate([rng.integers(97, 100, 5000, np.uint8), np.full(3000, 97, np.uint8), rng.integers(97, 123, 4000, np.uint8)])
    offsets = np.array([0, 100, len(raw)])
    flat = lambda found: sorted(map(tuple, np.concatenate([np.stack(t) for t in found], axis=1).T.tolist()))
    whole = flat([repeats.triggers(raw, offsets, repeats.of_bytes())])
    assert whole and all(flat(repeats.all_triggers(raw, offsets, repeats.of_bytes(), most)) == whole for most in (300, 1000, 5000))


LONG = 24 << 20


@pytest.mark.parametrize("name", ["quality", "ngrams", "decontaminate", "repeats", "tokens", "language", "licenses"])
def test_a_very_long_text_takes_bounded_memory(name):
    """In a process of its own: what a step over one text of 24 MB takes beyond the text and what it gives."""
    import subprocess
    import sys

    code = f"""
import resource, sys
import numpy as np
import public_tokenizers
from provenant.llm import decontaminate, langid, licenses, ngrams, quality, repeats, tokens
from provenant.llm.words import Words
rng = np.random.default_rng(0)
some = np.array([b"alpha", b"beta,", b"Gamma.", b"delta9", "été".encode()] + [b"w%d" % i for i in range(3000)])
text = b" ".join(b" ".join(rng.choice(some, 1 << 17).tolist()) for _ in range({LONG} // (6 << 17)))
raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
groups = decontaminate.build_groups(["w1 w2 w3", " ".join("w%d" % i for i in range(40))])
coder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
learned = langid.Classifier({{"a": (text[:90_000], 3), "b": (b"xyz " * 9000, 2)}})
as_text = text.decode()
scanner = licenses.Scanner()
run = {{
    "quality": lambda: quality.features(raw, offsets),
    "ngrams": lambda: (lambda w: (w.whole(), ngrams.signatures(w)))(Words(raw, offsets)),
    "decontaminate": lambda: decontaminate.search(raw, offsets, groups, {{}}),
    "repeats": lambda: sum(len(t[0]) for t in repeats.all_triggers(raw, offsets, repeats.of_bytes())) + sum(len(t[0]) for t in repeats.all_triggers(raw, offsets, repeats.of_words())),
    "tokens": lambda: coder.encode(raw, offsets),
    "language": lambda: learned.predict(as_text),
    "licenses": lambda: scanner.scan(as_text + " Released under the MIT License. " + as_text[:1000]),
}}["{name}"]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
run()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=False)
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout.split()[-1]) < 5 * LONG / (1 << 20), out.stdout


CLASHING = ("in0", "sid", "_h", "_block", "_bucket", "_at", "_k", "_in_hex", "_t", "_ranges", "_id", "_th", "_n", "_sig", "_l", "_in", "_rid", "_RID", "_least", "_c", "_text", "_b", "_other", "_found", "node", "words", "-", "a.b", "_order", "_Taken", "_links", "_score")


def operators():
    from public_tokenizers import path

    labels = lambda d: d.select("doc_id", F.lit(1).alias("quality"))
    item = lambda d: d.sparkSession.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    return {
        "mix": lambda d: mixing.mix(d, keep_undrawn=True), "quality": lambda d: quality.score(d, quality.fit(d, labels(d), F.lit(True))), "tokens": lambda d: tokens.token_output(d, path("word_bpe_49k.json")), "secrets": secrets.scan,
        "language": lambda d: langid.predict(d, langid.learn_dictionaries(d, F.lit(True))), "vectors": vectors.near_vectors, "repeats": repeats.remove_repeats, "holders": repeats.passage_holders,
        "decontaminate": lambda d: decontaminate.decontaminate(d, item(d)), "blocks": lambda d: decontaminate.decontaminate(d, item(d), max_block_bytes=3), "licenses": licenses.scan, "join": ngrams.similarity_join,
    }


@pytest.mark.parametrize("name", list(operators()))
def test_columns_that_clash_pass_through(spark, name):
    rng = random.Random(16)
    rows = [(i, prose(rng, 30), "en", rng.choice("ab"), i, [1.0, float(i % 3)], i % 2) for i in range(12)] + [(None, None, None, None, None, None, None), (3, "", "fr", "a", 1, [0.0, 0.0], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, vec_id long, embedding array<double>, label int")
    replaced = {"mix": ["_order", "_Taken"], "quality": ["_score"], "language": ["_score"], "vectors": ["_links"], "join": ["_links"], "decontaminate": ["_found"], "blocks": ["_found"]}.get(name, [])
    clashing = docs.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASHING))
    got = operators()[name](clashing)
    if name in ("tokens", "holders"):
        got.collect()
        return
    for r in got.collect():
        for i, c in enumerate(CLASHING):
            if c not in replaced:
                assert r[len(docs.columns) + i - sum(x in replaced for x in CLASHING[:i])] == f"mine {c}"
    assert got.columns[: len(docs.columns)] == docs.columns
