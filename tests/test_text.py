from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.functions import text as fn
from provenant.functions.shingles import hashes
from provenant.functions.vectors import cosine


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "number"), [("12", 12), ("十", 10), ("十二", 12), ("二十", 20), ("一百零三", 103), ("二百八十七", 287), ("三千零五", 3005), ("〇", 0), ("", 0)])
def test_chinese_number(spark, text, number):
    assert one(spark, text, fn.chinese_number) == number


def test_normalized(spark):
    assert one(spark, "“甲　乙”， （丙）：\n丁；。、", fn.normalized) == '"甲乙",(丙):丁;。、'


def test_short_title(spark):
    assert one(spark, "中华人民共和国刑法（2023年修正）", fn.short_title) == "刑法"
    assert one(spark, "外汇管理条例", fn.short_title) == "外汇管理条例"


def test_char_shingles(spark):
    assert one(spark, "abcdefg", fn.char_shingles) == ["abcdef", "bcdefg"]
    assert one(spark, "ab，cd\ne", fn.char_shingles) == []
    assert one(spark, "aaaaaaaa", fn.char_shingles) == ["aaaaaa"]
    assert one(spark, None, fn.char_shingles) in (None, [])


QUOTES = [
    ("任何单位不得提供", "第三条 任何单位不得提供账户。", True),
    ("任何单位……提供账户", "第三条 任何单位不得提供账户。", True),
    ("提供账户……任何单位", "第三条 任何单位不得提供账户。", False),  # in the wrong order
    ("“任何单位，不得”提供", '第三条 "任何单位,不得"提供账户。', True),
    ("任何单位不得提供账户，", "第三条 任何单位不得提供账户。", True),  # marks at the end don't matter
    ("应当", "应当", False),  # too short
    ("任何...任何单位", "任何单位", False),  # parts must not overlap
    ("……", "任何单位", False),
    (None, "任何单位", False),
    ("任何单位不得提供", None, False),
]


@pytest.mark.parametrize(("quote", "text", "valid"), QUOTES)
def test_quote_in_text(spark, quote, text, valid):
    row = spark.createDataFrame([(quote, text)], "q string, t string").select(fn.quote_in_text(F.col("q"), F.col("t")).alias("y")).first()
    assert row["y"] is valid


def test_valid_quotes_are_substrings(spark):
    """Whatever parts of a text are quoted in order, they are found; and a found quotation without ellipsis stands in the text."""

    @settings(max_examples=15, deadline=None)
    @given(st.text("ab。c ", min_size=12, max_size=40), st.integers(0, 11), st.integers(1, 12))
    def check(text, a, n):
        quote = text[a : a + n]
        found = spark.createDataFrame([(quote, text)], "q string, t string").select(fn.quote_in_text(F.col("q"), F.col("t")).alias("y")).first()["y"]
        bare = re.sub(r"\s", "", quote).strip(fn.EDGE_MARKS)
        assert found == (len(bare) >= 6)

    check()


def test_missing_points(spark):
    row = spark.createDataFrame([("共 1,234,567 元，需 申报",)], "a string").select(fn.missing_points(F.col("a"), F.array(*map(F.lit, ["1234567", "申报|备案", "许可|备案"]))).alias("m")).first()
    assert row["m"] == ["许可|备案"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]


@given(st.text("ab，。“ 　\u2028éあ😀(c", max_size=40))
def test_shingle_hashes_are_of_the_same_sets(text):
    bare = re.sub(r"[\s，。、；：（）()“”\"'【】《》]", "", text)
    assert len(hashes([text])[0]) == len({bare[i : i + 6] for i in range(len(bare) - 5)})
    assert (hashes([text])[0] == hashes([bare])[0]).all()
