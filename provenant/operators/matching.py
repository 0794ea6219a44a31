"""Joins of texts with tables of regular expressions, through literals that every match must hold.

From each pattern a few literals are derived of which any match holds one. Texts and literals meet by two characters, the literal is looked for in the text, and only then
the pattern is tried, so the work grows with what texts and rules share, not with texts times rules. Patterns without such literals (and those
that aren't understood) meet every text, as all do where there are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from re import _constants as sre
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.session import checkpointed, small

#: Up to so many rules every text meets all of them: a broadcast and no shuffle.
FEW_RULES = 1_000
#: Characters of a literal by which it is found, and most literals of a pattern.
KEY, MOST_LITERALS = 2, 64


def folded(text: str) -> str:
    """A-Z in lower case, which is what patterns that ignore case ignore."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest literal is longer; of equal ones the smaller."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _mandatory(items) -> set[str] | None:
    best, run = None, ""
    for op, value in items:
        if op is sre.LITERAL:
            run += chr(value)
            continue
        best, run = _better(best, {run} if run else None), ""
        if op is sre.SUBPATTERN:
            best = _better(best, _mandatory(value[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] >= 1:
            best = _better(best, _mandatory(value[2]))
        elif op is sre.BRANCH:
            each = [_mandatory(b) for b in value[1]]
            if all(each) and sum(map(len, each)) <= MOST_LITERALS:
                best = _better(best, set().union(*each))
    return _better(best, {run} if run else None)


def literals(pattern: str) -> list[str] | None:
    """Literals, A-Z in lower case, of which every match holds one; None if there are none of two characters or more, or the pattern isn't understood."""
    try:
        found = _mandatory(parser.parse(pattern))
    except Exception:  # syntax of Java's own
        return None
    # a letter whose other case isn't A-Z could match beside its lower case where a pattern ignores case
    if not found or any(len(x) < KEY or any(c.lower() != c.upper() and not c.isascii() for c in x) for x in found) or "\\Q" in pattern:
        return None
    return sorted({folded(x) for x in found})


def lowered(text: Column) -> Column:
    """``folded`` as a column."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def regex_join(texts: DataFrame, rules: DataFrame, *, text: str = "_q", key: str = "query_id", pattern: str = "pattern", prefix: str = "", few: int = FEW_RULES) -> DataFrame:
    """Rows of ``texts`` (key, text) with each of the ``rules`` whose pattern, behind ``prefix``, is found in the text."""
    matches = F.expr(f"{text} rlike concat('{prefix}', {pattern})")
    if rules.limit(few + 1).count() <= few:
        return texts.join(small(rules), matches)
    numbered = checkpointed(rules.withColumn("_rule", F.monotonically_increasing_id()))

    def derive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r, x) for r, p in zip(frame["_rule"], frame["_p"], strict=True) if p is not None for x in (literals(p) or [None])]
            yield pd.DataFrame(rows, columns=["_rule", "_literal"])

    derived = checkpointed(numbered.select("_rule", F.col(pattern).alias("_p")).mapInPandas(derive, "_rule long, _literal string"))
    found = derived.where("_literal is not null").withColumn("_two", F.substring("_literal", 1, KEY))
    low = texts.select(key, lowered(F.col(text)).alias("_low"))
    pairs = F.when(F.length("_low") >= KEY, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - (KEY - 1)), lambda i: F.substr("_low", i, F.lit(KEY))))).otherwise(F.array().cast("array<string>"))
    met = low.select(key, "_low", F.explode(pairs).alias("_two")).join(found, "_two").where(F.contains("_low", F.col("_literal"))).select(key, "_rule").distinct()
    through = texts.join(met, key).join(numbered, "_rule").where(matches).drop("_rule")
    rest = numbered.join(derived.where("_literal is null").select("_rule"), "_rule", "left_semi").drop("_rule")
    scanned = texts.join(small(checkpointed(rest)), matches)
    return through.select(*scanned.columns).unionByName(scanned)
