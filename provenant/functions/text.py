"""Column functions over text: normalising, Chinese numerals, shingles, ordered fragments, key points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script; (?U) makes \s hold the ideographic space and its like.
SPACE = r"(?U)\s+"

# What a quotation and its source must be told apart by, and what not.
UNIFY_FROM, UNIFY_TO = "“”‘’（），：；", "\"\"''(),:;"
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
SHINGLE_DROPS = r"""(?U)[\s，。、；：（）()“”"'【】《》]"""
SHINGLE = 6
ELLIPSIS = r"……|\.\.\.|…"
EDGE_MARKS = ",.;:、!?。！？"
LEAST_QUOTE = 6


def without_space(text: Column) -> Column:
    """No white space at all."""
    return F.regexp_replace(text, SPACE, "")


def normalized(text: Column) -> Column:
    """For comparing quotations: no white space; one form of quotation marks, brackets, commas, colons and semicolons."""
    return F.translate(without_space(text), UNIFY_FROM, UNIFY_TO)


def chinese_number(text: Column) -> Column:
    """Value of a numeral in digits or in Chinese up to thousands; a unit without a digit before it counts once."""
    pick = lambda table, c: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))

    def step(z: Column, c: Column) -> Column:
        unit, digit = pick(CN_UNITS, c), pick(CN_DIGITS, c)
        times = F.when(z["digit"] == 0, 1).otherwise(z["digit"])
        return (
            F.when(digit.isNotNull(), F.struct(z["sum"].alias("sum"), digit.alias("digit")))
            .when(unit.isNotNull(), F.struct((z["sum"] + times * unit).alias("sum"), F.lit(0).alias("digit")))
            .otherwise(z)
        )

    spelled = F.aggregate(F.split(text, ""), start, step, lambda z: z["sum"] + z["digit"])
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(spelled)


def short_title(title: Column) -> Column:
    """Without the country's name in front and a bracketed remark at the end."""
    return F.regexp_replace(F.regexp_replace(title, "^中华人民共和国", ""), "（.*?）$", "")


def char_shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n characters, without white space and common marks; none if there are fewer characters."""
    chars = F.filter(F.split(F.regexp_replace(text, SHINGLE_DROPS, ""), ""), lambda c: c != "")

    def runs(c: Column) -> Column:
        at = F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(c, i, n), "")))

    # the characters are bound to a variable: an expression in the inner function would be computed for each of its elements
    return F.transform(F.array(chars), runs)[0]


def trimmed(text: Column, marks: str) -> Column:
    """Without any of ``marks`` at either end."""
    return F.trim(text, F.lit(marks))


def fragments(quote: Column) -> Column:
    """A quotation's parts between ellipses, normalised, without marks and then quotation marks at their ends; empty ones go."""
    parts = F.transform(F.split(quote, ELLIPSIS), lambda p: trimmed(trimmed(normalized(p), EDGE_MARKS), "\"'"))
    return F.filter(parts, lambda p: p != "")


def quote_in_text(quote: Column, text: Column, least: int = LEAST_QUOTE) -> Column:
    """Whether the quotation's parts stand in the text in order without overlap, and have ``least`` characters together."""
    body = normalized(text)

    def step(end: Column, p: Column) -> Column:
        at = F.call_function("locate", p, body, end + 1)  # from 1; 0 if it isn't there
        return F.when((end < 0) | (at == 0), F.lit(-1)).otherwise(at + F.length(p) - 1)

    parts = fragments(quote)
    long = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p)) >= least
    return F.coalesce(long & (F.aggregate(parts, F.lit(0), step) >= 0), F.lit(False))


def missing_points(answer: Column, must: Column) -> Column:
    """The key points that an answer lacks. ``a|b`` is met by either; white space and thousands commas don't matter."""
    text = F.regexp_replace(without_space(answer), r"(?<=\d),(?=\d{3})", "")
    met = lambda m: F.exists(F.split(m, r"\|"), lambda a: F.contains(text, without_space(a)))
    return F.filter(must, lambda m: ~met(m))


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
