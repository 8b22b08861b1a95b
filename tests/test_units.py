"""Problem 1: reading numbers and units, and pairs of equal quantities, against a plain nested loop."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import units as U

RESULT = "result_id bigint, doc_id bigint, id string, name string, value string, unit string, source_text string"
FACTORS = [
    ("currency unit", "amount", "currency unit", 1.0), ("percent", "ratio", "percent", 1.0), ("per mille", "ratio", "percent", 0.1), ("basis point", "ratio", "percent", 0.01), ("fraction of one", "ratio", "percent", 100.0),
    ("person", "people", "person", 1.0), ("account", "accounts", "account", 1.0), ("square metre", "area", "square metre", 1.0), ("square foot", "area", "square metre", 0.092903), ("tonne", "mass", "tonne", 1.0), ("kilogram", "mass", "tonne", 0.001),
    ("kilotonne", "mass", "tonne", 1000.0), ("kilowatt hour", "energy", "kilowatt hour", 1.0), ("share", "shares", "share", 1.0), ("lot", "shares", "share", 100.0),
]


def cheapest(text):
    return min(U.readings(text), key=lambda r: r[-1])[:4]


@pytest.mark.parametrize(
    "text, unit, scale, money, times",
    [
        ("RMBbn", "currency unit", 1.0, "CNY", 1e9), ("HK$'000", "currency unit", 1.0, "HKD", 1e3), ("美元万元", "currency unit", 1.0, "USD", 1e4), ("萬元", "currency unit", 1.0, "CNY", 1e4), ("thousands of EUR", "currency unit", 1.0, "EUR", 1e3),
        ("RMB (in full)", "currency unit", 1.0, "CNY", 1.0), ("'000 sq ft", "square foot", 1.0, None, 1e3), ("万㎡", "square metre", 1.0, None, 1e4), ("ft²", "square foot", 1.0, None, 1.0), ("万千瓦时", "kilowatt hour", 1.0, None, 1e4),
        ("ratio (1 = 100%)", "fraction of one", 1.0, None, 1.0), ("BASIS POINTS", "basis point", 1.0, None, 1.0), ("mn", None, 1.0, None, 1e6), ("kt", "kilotonne", 1.0, None, 1.0), ("十亿元 ", "currency unit", 1.0, "CNY", 1e9),
    ],
)
def test_readings(text, unit, scale, money, times):
    assert cheapest(text) == (unit, scale, money, times)


@pytest.mark.parametrize("text", ["", " ", "see note", "blurb", "元 people", "x" * 500])
def test_no_reading(text):
    assert U.readings(text) == ()


@pytest.mark.parametrize(
    "value, number, rest",
    [("(27，054，701.8)", -27054701.8, ""), ("（391,3)", -391.3, ""), ("-RMB9.9 mn", -9.9, "rmb mn"), ("3,455,582'000 shares", 3455582.0, "'000 shares"), ("1 234 567,8", 1234567.8, ""), ("4.0284900e+08", 402849000.0, ""), ("−5 %", -5.0, "%"), ("1.062,7 Mio. EUR", 1062.7, "mio. eur")],
)
def test_values(value, number, rest):
    assert U.split_value(value) == (pytest.approx(number), rest)


@pytest.mark.parametrize("value", [None, "", "-", "—", "N/A", "null", "none at all"])
def test_absent_values(value):
    assert U.split_value(value) is None


def test_decimal_mark_of_the_language():
    assert U.number("1.234") == 1.234 and U.number("1.234", True) == 1234.0 and U.number("1,234") == 1234.0 and U.number("1,234", True) == 1.234


def test_source_text_tells_the_unit():
    for source in ("单位：亿股。库存：23.27（附注5）", "(in HKD bn) Assets was 23.27 for the year", "以HKD bn列示，Assets：23.27（经审计）", "Assets: 23.27 HKD bn (note 5)"):
        number, told = U.row_readings("23.27", None, source, "Assets" if "Assets" in source else "库存", False)
        assert number == 23.27 and told, source
    assert U.row_readings("23.27", None, "Assets was 23.27 for the year", "Assets", False)[1] == ()


def brute_force(rows):
    """All pairs by the definition, on quantities read one by one."""
    table = {f[0]: f[1:] for f in FACTORS}
    usual = {"staff": ("people", "person"), "assets": ("amount", "currency unit")}
    known = []
    for rid, doc, id_, name, value, unit, source in rows:
        found = U.row_readings(value, unit, source, name, False)
        if found and found[1] and doc is not None and id_ is not None:
            unit_name, scale, money, times, _ = min(found[1], key=lambda r: r[-1])
            kind, _, factor = table[unit_name] if unit_name else (*usual[name], 1.0)
            if kind != "amount" or money:
                known.append((rid, doc, id_, kind, money, found[0] * times * scale * factor, times * scale * factor))
    out = set()
    for a, b in itertools.combinations(known, 2):
        if a[1:5] == b[1:5] and a[6] != b[6] and abs(a[5] - b[5]) <= 0.005 * max(abs(a[5]), abs(b[5])):
            out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_against_brute_force(spark):
    random.seed(4)
    rows, n = [], 0
    for doc in range(40):
        base = random.choice([0.0, 1234.0, 98765.0])
        for unit, factor in random.choices([("RMB mn", 1e6), ("万元", 1e4), ("RMB", 1.0), ("HKD mn", 1e6), ("千元", 1e3), ("RMB thousand", 1e3), (None, 1.0)], k=5):
            n += 1
            rows.append((n, doc % 30, "R1", "assets", str(round(base * random.choice([1, 1, 1.004, 1.006, -1]) * 1e6 / factor, 4)), unit, None))
    for unit, value in (("people", "5000"), ("千人", "5"), ("k", "5"), ("persons", "5000"), ("k", "5")):
        n += 1
        rows.append((n, 99, "R2", "staff", value, unit, None))
    read = U.read_units(spark.createDataFrame(rows, RESULT), spark.createDataFrame(FACTORS, "unit_name string, kind string, common_unit string, factor double"))
    got = {tuple(r) for r in U.same_quantities(read).collect()}
    assert got == brute_force(rows) and len(got) > 10


def test_every_row_has_a_result_whatever_is_null(spark):
    rows = [(1, 1, "a", "staff", None, None, None), (2, None, None, None, "5", "千人", None), (3, 1, "a", None, "5", "", "Unit: k; 5"), (3, 1, "a", None, "5", "", "Unit: k; 5"), (None, 1, "a", "staff", "", " ", ""), (5, 1, "a", "staff", "9" * 400, "people", "x" * 100_000)]
    frame = spark.createDataFrame(rows, RESULT).withColumn("kind", F.lit("clash")).withColumn("_comma", F.lit(1)).withColumn("number", F.lit("clash"))
    read = U.read_units(frame, spark.createDataFrame(FACTORS, "unit_name string, kind string, common_unit string, factor double"))
    assert read.count() == 6
    U.same_quantities(read).collect()


def test_empty_table(spark):
    read = U.read_units(spark.createDataFrame([], RESULT), spark.createDataFrame(FACTORS, "unit_name string, kind string, common_unit string, factor double"))
    assert read.count() == 0 and U.same_quantities(read).count() == 0


def test_many_equal_rows_aren_t_paired_with_each_other(spark):
    rows = [(i, 1, "R", "assets", "5", "RMB mn", None) for i in range(2000)] + [(9001, 1, "R", "assets", "5000", "RMB thousand", None)]
    read = U.read_units(spark.createDataFrame(rows, RESULT), spark.createDataFrame(FACTORS, "unit_name string, kind string, common_unit string, factor double"))
    assert U.same_quantities(read).count() == 2000


def test_a_unit_of_any_length_is_read():
    long = "RMB" + " in" * 60 + " thousand"
    assert U.readings(long) == U.readings("RMB thousand") != () or U.readings(long)[0][:4] == U.readings("RMB thousand")[0][:4]
    assert U.readings("万" * 5000) != () and U.readings("no unit at all " * 5000) == ()
