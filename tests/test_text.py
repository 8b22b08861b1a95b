"""Column functions against Python, and the golden cases of the pipeline's own readings."""

import fnmatch
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import numbers, text

TRICKY = ["", " ", "Ａb　C", "ﬁnance", "été", "a\tb\nc", "Σ", None, "①２㎡", "x" * 50_000, " x　"]


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.select(expression(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def test_match_form(spark):
    want = ["".join(unicodedata.normalize("NFKC", v or "").lower().split()) for v in TRICKY]
    assert column(spark, TRICKY, text.match_form) == want


def test_strip(spark):
    assert column(spark, TRICKY, text.strip) == [v if v is None else v.strip() for v in TRICKY]


def test_lines(spark):
    values = ["a\nb\n", "a\r\nb\rc", "\n", "", None, "a b", "a\n\nb", "\n\na"]
    assert column(spark, values, text.lines_of) == [(v or "").splitlines() for v in values]


def test_either_of(spark):
    assert column(spark, ["a/ b ", "/", "", " ", "x", "a//b", "/a"], text.either_of) == [["a", "b"], ["/"], [], [], ["x"], ["a", "b"], ["a"]]


def test_lists_and_bools(spark):
    assert column(spark, ["a；b;c，d\ne/f", "", None, " ,x"], text.parse_list) == [["a", "b", "c", "d", "e/f"], [], [], ["x"]]
    assert column(spark, ["是", "√", "Y", "no", "", None, "TRUE"], lambda c: text.parse_bool(c, True)) == [True, True, True, False, True, True, True]
    assert column(spark, ["", None], lambda c: text.parse_bool(c, False)) == [False, False]


def test_inline_markdown(spark):
    assert column(spark, ["**a** *b* `c` [d](e) ![f](g)"], text.strip_inline_markdown) == ["a b c d f"]


def test_value_with_unit(spark):
    frame = spark.createDataFrame([("5", "%"), ("5", ""), ("5", None), (None, "%"), ("null", "x"), ("0", "x")], "v string, u string")
    assert [r[0] for r in frame.select(text.value_with_unit(F.col("v"), F.col("u"))).collect()] == ["5 %", "5", "5", "", "", "0 x"]


@pytest.mark.parametrize("pattern, names", [("*x*", ["a/x/b", "X", "y"]), ("a?.md", ["ab.md", "a.md", "abc.md"]), ("[!a]b", ["cb", "ab", "]b"]), ("a.b", ["a.b", "aXb"]), ("[ab", ["[ab", "a"])])
def test_globs(pattern, names):
    import re

    for name in names:
        assert bool(re.search(text.glob_to_regex(pattern), name)) == fnmatch.fnmatch(name.lower(), pattern.lower()), (pattern, name)


@pytest.mark.parametrize(
    "value, number",
    [("(1,234.50)", -1234.5), ("(-5)", -5.0), ("1，234", 1234.0), ("2024年 1,234", 2024.0), ("1.2e5", 1.2), ("—", None), ("N/A", None), ("null", None), ("", None), (None, None), ("（12）", 12.0), ("−7", 7.0), ("-3%", -3.0), ("１２", 12.0), ("none", None), ("abc", None)],
)
def test_pipeline_numbers(spark, value, number):
    assert column(spark, [value], numbers.parse_number) == [number]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=8))
def test_lines_property(spark, values):
    assert column(spark, values, text.lines_of) == [v.splitlines() for v in values] if values else True
