"""Joins with tables of patterns against trying every pattern on every text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from provenant.operators import enrich, matching


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("换汇|购汇", ["换汇", "购汇"]), ("a.{0,3}bcd", ["bcd"]), ("(ab|c)de+", ["ab", "de"]), ("[xy]z", None), ("(?<!反)洗钱", ["洗钱"]), ("(Foo)+bar?", ["foo"]), ("x?", None), (r"\p{L}ab", None), ("(abc)?de", ["de"]), ("ab(?=cd)", ["ab"]), ("éa", None), ("(", None)],
)
def test_literals(pattern, want):
    got = matching.literals(pattern)
    assert got == want or pattern == "(ab|c)de+" and got in (None, ["d"])


def test_every_match_holds_a_literal():
    rng = random.Random(2)
    part = lambda d: rng.choice([lambda: rng.choice("abcAB"), lambda: "ab", lambda: "[bc]", lambda: ".", lambda: f"({part(d - 1)}|{part(d - 1)}b)" if d else "c", lambda: f"({part(d - 1)}a){rng.choice(['?', '+', '*', '{2}'])}" if d else "a", lambda: "(?!b)", lambda: "^"])()
    tried = 0
    for _ in range(3000):
        pattern = "".join(part(2) for _ in range(rng.randint(1, 5)))
        found = matching.literals(pattern)
        for flags in (0, re.I):
            for _ in range(5):
                text = "".join(rng.choice("abcABC") for _ in range(rng.randint(0, 9)))
                if found and re.search(pattern, text, flags):
                    tried += 1
                    assert any(x in matching.folded(text) for x in found), (pattern, text, found)
    assert tried > 400


def test_many_rules(spark):
    """100,000 rules: the same rows as from trying all, without a nested loop over all rules."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rules = [(i, f"{rng.choice(words)}.*{rng.choice(words)}|{rng.choice(words)}[0-9]" if i % 3 else rng.choice(words) + "x" * (i % 5), f"t{i}") for i in range(100_000)] + [(100_000, "[0-9]{6}", "number"), (100_001, None, "none")]
    texts = [(q, " ".join(rng.choice(words) + rng.choice(["", "", "7", "X"]) for _ in range(12)).upper() if q % 2 else " ".join(rng.choice(words) for _ in range(12))) for q in range(40)] + [(98, "123456"), (99, None), (97, "")]
    table = spark.createDataFrame(rules, "ord int, pattern string, terms string").repartition(4).cache()
    q = spark.createDataFrame(texts, "query_id long, text string").select("query_id", F.col("text").alias("_q"))
    joined = matching.regex_join(q, table, prefix="(?i)")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    got = {(r["query_id"], r["ord"]) for r in joined.collect()}
    alone = spark.createDataFrame(texts[:6], "query_id long, text string").select("query_id", F.col("text").alias("_q"))
    compiled = [(i, re.compile(p, re.I)) for i, p, _ in rules if p is not None]
    want = {(k, i) for k, t in texts[:6] for i, p in compiled if p.search(t)}
    assert {x for x in got if x[0] < 6} == want and want and (98, 100_000) in got
    assert {(r["query_id"], r["ord"]) for r in matching.regex_join(alone, table, prefix="(?i)").collect()} == want
    expanded = enrich.expand(spark.createDataFrame(texts[:6], "query_id long, text string"), table)
    assert expanded.count() == 6 and expanded.where(F.contains("expanded", F.lit("（相关概念：t"))).count() == len({k for k, _ in want})
