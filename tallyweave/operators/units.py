"""Problem 1: bring quantities recorded in different units to common units.

A unit string is segmented by dynamic programming over tries of multipliers and
currencies (prefixes), unit roots and exponents. A string may have several
readings; how often each kind of unit occurs with the metric's name decides
between them, and gives a multiplier that stands alone its unit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Spellings of multipliers.
MULTIPLIERS = {
    1e2: "hundred 百 hecto",
    1e3: "thousand thousands k '000 ’000 000s 千 仟 tsd tausend millier milliers miles",
    1e4: "万 萬",
    1e5: "十万 十萬 lakh",
    1e6: "million millions m mn mm mln mio mio. millionen millón millones 百万 百萬 佰万",
    1e7: "千万 千萬 crore",
    1e8: "亿 億",
    1e9: "billion billions bn b mrd mrd. milliarde milliarden milliard milliards md 十亿 十億",
    1e10: "百亿 百億",
    1e12: "trillion trillions tn 万亿 萬億 billón",
}
# Spellings of currencies; what only names the money of an unnamed currency is yuan.
CURRENCIES = {
    "CNY": "rmb cny 人民币 人民幣 renminbi yuan 元 圆 圓 块",
    "HKD": "hk$ hkd 港币 港幣 港元 港纸",
    "USD": "us$ usd 美元 美金 $",
    "EUR": "eur € euro euros 欧元 歐元",
    "JPY": "jpy 日元 日圆 日圓 円 yen",
    "GBP": "gbp £ 英镑 英鎊",
    "CHF": "chf 瑞士法郎",
    "SGD": "sgd s$ 新加坡元",
    "TWD": "twd nt$ 新台币 新臺幣",
    "KRW": "krw 韩元 ₩",
}
#: Words of money that follow a currency without naming another ("美元万元").
MONEY = "元 圆 圓 dollars dollar"
# Spellings of unit roots, with the plain name of the unit and how many of it one is.
ROOTS = {
    ("percent", 1.0): "% percent per cent pct pct. 百分比 百分点 prozent pour cent por ciento パーセント",
    ("per mille", 1.0): "‰ per mille permille per mil 千分比 千分之 promille pour mille por mil",
    ("basis point", 1.0): "bp bps basis point basis points basispunkte 基点 基點",
    ("fraction of one", 1.0): "fraction decimal 小数 小數 比值 ratio 倍 times x 割合",
    ("person", 1.0): "person persons people employee employees fte ftes staff headcount heads 人 名 位 personen mitarbeiter beschäftigte personne personnes salarié salariés persona personas empleado empleados 員 个 個",
    ("account", 1.0): "account accounts client clients customer customers a/c 户 戶 账户 帳戶 个 個 位 名 konten kunden comptes cuentas 口座",
    ("hectare", 1.0): "ha hectare hectares hektar 公顷 公頃",
    ("mu", 1.0): "mu 亩 畝",
    ("share", 1.0): "share shares 股 stock aktie aktien action actions acción acciones 株",
    ("lot", 1.0): "lot lots board lot board lots 手",
    ("kilowatt hour", 1.0): "kwh kilowatt hour kilowatt hours kilowatt-hour kilowatt-hours 千瓦时 千瓦時 千瓦小时 度 kw·h",
    ("kilowatt hour", 1e-3): "wh watt hour watt hours watt-hours 瓦时 瓦時",
    ("megawatt hour", 1.0): "mwh megawatt hour megawatt hours megawatt-hour megawatt-hours 兆瓦时 兆瓦時",
    ("gigawatt hour", 1.0): "gwh gigawatt hour gigawatt hours gigawatt-hour gigawatt-hours 吉瓦时 吉瓦時",
    ("gigajoule", 1.0): "gj gigajoule gigajoules 吉焦 吉焦耳",
    ("gigajoule", 1e-3): "mj megajoule megajoules 兆焦",
    ("tonne", 1.0): "t tonne tonnes ton tons metric ton metric tons 吨 噸 公吨 tonnen tonelada toneladas トン",
    ("kilogram", 1.0): "kg kilogram kilograms kilogramm kilo kilos 公斤 千克",
    ("kilogram", 1e-3): "g gram grams gramm 克",
    ("kilotonne", 1.0): "kt kilotonne kilotonnes kiloton kilotons",
}
# Lengths, which an exponent turns into areas.
LENGTHS = {
    ("square metre", 1.0): "m metre metres meter meters 米 mètre mètres metro metros",
    ("square metre", 1e6): "km kilometre kilometres kilometer kilometers 公里 千米",
    ("square foot", 1.0): "ft ft. foot feet 呎 英尺",
}
SQUARE_BEFORE = "sq sq. square 平方 quadrat"
SQUARE_AFTER = "2 ^2 ² carrés carré cuadrados"
#: Signs between the parts that mean nothing.
FILLERS = [" ", "of", "in", "(in full)", "in full", "(1 = 100%)", "(1=100%)", "d'", "de", "-", "・"]
#: Spellings made of several words; the others are split at spaces.
PHRASES = ["per cent", "per mille", "per mil", "pour cent", "por ciento", "pour mille", "por mil", "basis points", "basis point", "metric tons", "metric ton", "board lots", "board lot"] + [
    f"{p}watt {h}" for p in ("kilo", "mega", "giga", "") for h in ("hours", "hour")
]
ABSENT = {"", "-", "—", "–", "--", "n/a", "na", "null", "none", "nil", "/"}


def _spellings(text: str) -> list[str]:
    found = []
    for phrase in PHRASES:
        if re.search(rf"(?<![\w-]){phrase}(?![\w-])", text):
            found.append(phrase)
            text = re.sub(rf"(?<![\w-]){phrase}(?![\w-])", " ", text)
    return found + text.split()


def _trie(entries: Iterator[tuple[str, tuple]]) -> dict:
    root: dict = {}
    for spelling, meaning in entries:
        node = root
        for c in spelling:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(meaning)
    return root


TRIE = _trie(
    iter(
        [(s, ("times", by)) for by, text in MULTIPLIERS.items() for s in _spellings(text)]
        + [(s, ("money", code)) for code, text in CURRENCIES.items() for s in _spellings(text)]
        + [(s, ("coin", None)) for s in MONEY.split()]
        + [(s, ("root", unit)) for unit, text in ROOTS.items() for s in _spellings(text)]
        + [(s, ("length", unit)) for unit, text in LENGTHS.items() for s in _spellings(text)]
        + [(s, ("square", None)) for s in SQUARE_BEFORE.split() + SQUARE_AFTER.split()]
        + [(s, ("filler", None)) for s in FILLERS]
    )
)

# A reading in progress: multiplier, currency, (unit, scale), squares seen, length seen
_START = (1.0, None, None, 0, None)


def _extend(state: tuple, meaning: tuple) -> tuple | None:
    times, money, unit, squares, length = state
    what, value = meaning
    if what == "filler":
        return state
    if what == "times":
        return (times * value, money, unit, squares, length)
    if what == "money":
        return None if unit or length or money not in (None, value) else (times, value, unit, squares, length)
    if what == "coin":
        return state if money else None
    if what == "root":
        return None if money or unit or length else (times, money, value, squares, length)
    if what == "length":
        return None if money or unit or length else (times, money, unit, squares, value)
    return None if money or unit or squares else (times, money, unit, 1, length)


def _norm(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "").replace("\u200b", "").replace("\ufeff", "").replace("’", "'").casefold()
    return re.sub(r"\s+", " ", text).strip(" .,;:，；：。")


def _joint(text: str, i: int, j: int) -> bool:
    """Whether cutting ``text`` at j splits a word of four or more letters that no entry covers from i."""
    return j < len(text) and text[j - 1].isascii() and text[j].isascii() and text[j - 1].isalpha() and text[j].isalpha()


#: Longest unit string whose readings a worker's memo keeps.
MEMO_LENGTH = 80


def readings(text: str) -> tuple[tuple[str | None, float, str | None, float, float], ...]:
    """All cheapest readings (unit name, scale, currency, multiplier, cost) of a unit string.

    The unit name is "currency unit" for money and None for a multiplier alone.
    """
    return _kept_readings(text) if len(text) <= MEMO_LENGTH else _readings(text)


def _readings(text: str) -> tuple[tuple[str | None, float, str | None, float, float], ...]:
    s = _norm(text)
    if not s:
        return ()
    best: list[dict[tuple, float]] = [{} for _ in range(len(s) + 1)]
    best[0][_START] = 0.0
    for i in range(len(s)):
        if not best[i]:
            continue
        node, j = TRIE, i
        while j < len(s) and s[j] in node:
            node = node[s[j]]
            j += 1
            for meaning in node.get("", ()):
                # splitting a Latin word ("rmbbn", "eurm") costs more than taking it whole
                cost = (0.1 if meaning[0] == "filler" else 1.0) + (1.0 if _joint(s, i, j) else 0.0)
                for state, sofar in best[i].items():
                    after = _extend(state, meaning)
                    if after is not None and sofar + cost < best[j].get(after, math.inf):
                        best[j][after] = sofar + cost
    out: dict[tuple, float] = {}
    for (times, money, unit, squares, length), cost in best[-1].items():
        if length and squares:
            reading = (*length, None, times)
        elif length or squares:
            continue
        elif unit:
            reading = (*unit, None, times)
        elif money:
            reading = ("currency unit", 1.0, money, times)
        elif times != 1.0:
            reading = (None, 1.0, None, times)
        else:
            continue
        out[reading] = min(cost, out.get(reading, math.inf))
    return tuple((*r, c) for r, c in sorted(out.items(), key=lambda x: (x[1], str(x[0]))))


_kept_readings = lru_cache(maxsize=100_000)(_readings)

_NUMBER = re.compile(r"\d{1,3}(?:[ \u00a0\u202f\u2009]\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)*(?:e[+-]?\d+)?|\.\d+")


def number(text: str, comma_decimal: bool = False) -> float:
    """Value of a written number; with one separator and three digits after it the language's mark decides."""
    text = re.sub(r"[ \u00a0\u202f\u2009]", "", text)
    mantissa, _, power = text.partition("e")
    dots, commas = mantissa.count("."), mantissa.count(",")
    if dots and commas:
        decimal = max(".", ",", key=mantissa.rfind)
    elif dots + commas == 1:
        mark = "." if dots else ","
        grouped = len(mantissa.rpartition(mark)[2]) == 3 and 1 <= mantissa.index(mark) <= 3 and not mantissa.startswith("0") and not power
        decimal = mark if not grouped else "," if comma_decimal else "."
    else:
        decimal = None  # none at all, or one mark several times: groups
    for mark in ".,":
        mantissa = mantissa.replace(mark, "." if mark == decimal else "")
    return float(mantissa + ("e" + power if power else ""))


def split_value(value: str | None, comma_decimal: bool = False) -> tuple[float, str] | None:
    """(number with sign, what is written around it) of a value, None if it holds no number, or one beyond all bounds."""
    s = _norm(value)
    if s in ABSENT:
        return None
    m = _NUMBER.search(s)
    if not m:
        return None
    before, after = s[: m.start()], s[m.end() :]
    negative = bool(re.search(r"[-−–﹣]\s*[^\d\s]{0,5}\s*$", before)) or (("(" in before) and (")" in after) and not before.rpartition("(")[2].strip(" -") .startswith("in "))
    if negative and "(" in before and ")" in after:
        before, after = before.replace("(", "", 1), after.replace(")", "", 1)
    before = re.sub(r"[-−–﹣+]", "", before)
    magnitude = number(m.group(0), comma_decimal)
    if not math.isfinite(magnitude):
        return None
    return (-magnitude if negative else magnitude), f"{before.strip()} {after.strip()}".strip()


_CUES = re.compile(
    r"[:：;；。()（）,，\x00\x01|]|\.\.\.|单位为?|以|列示|表示|计量|计价|除另有说明外|金额均?|均|\b(?:unit|units|expressed|stated|in|was|were|is|are|for the year|amounts?|all|figures|einheit|unité|unidad|note \d+)\b|附注\d*|は|注記\d*|単位"
)


def _source_readings(text: str) -> tuple:
    text = text.replace("(in full)", " ").replace("(1 = 100%)", " ")
    after = text.rpartition("\x01")[2] if "\x01" in text else ""
    for part in [p for p in _CUES.split(after)[:1] if p] + _CUES.split(text):
        if part and part.strip() and (found := readings(part)):
            return found
    return ()


_kept_source_readings = lru_cache(maxsize=100_000)(_source_readings)


def source_readings(source: str | None, name: str | None, value: str | None) -> tuple:
    """Readings of the unit that a source text states, beside the value first."""
    if not source:
        return ()
    s, name, value = _norm(source), _norm(name), _norm(value)
    if value and value not in ABSENT:
        s = s.replace(value, "\x01", 1)
    if name:
        s = s.replace(name, "\x00")
    s = re.sub(r"(附注|注記|note )\d+", r"\g<1>0", s)
    return _kept_source_readings(s) if len(s) <= 4 * MEMO_LENGTH else _source_readings(s)


def _join_readings(inner: tuple, outer: tuple) -> tuple:
    """What the value itself says goes before what the unit column says."""
    if not inner:
        return outer
    if not outer or any(r[0] is not None and r[3] != 1.0 for r in inner):
        return inner
    out = []
    for unit, scale, money, times, cost in inner:
        if unit is None:  # a multiplier, of the outer unit
            out += [(u, s, m, times, cost + c) for u, s, m, t, c in outer if t in (1.0, times)]
        elif unit == "currency unit":  # "HK$5" under "million"
            out += [(unit, scale, money, t, cost + c) for u, s, m, t, c in outer if u in (None, unit) and m in (None, money)]
    return tuple(out) or inner


def read_row(value: str | None, unit: str | None, source: str | None, name: str | None) -> tuple[float, float, tuple] | None:
    """(number with a decimal point, with a decimal comma, readings) of a result; no readings if its unit can't be told."""
    found = split_value(value)
    if found is None:
        return None
    comma = split_value(value, True)
    inner = readings(found[1]) if found[1] else ()
    told = _join_readings(inner, readings(unit) if unit and unit.strip() else ())
    return found[0], comma[0] if comma else found[0], told or source_readings(source, name, value)


def row_readings(value: str | None, unit: str | None, source: str | None, name: str | None, comma_decimal: bool) -> tuple[float, tuple] | None:
    """(number, readings) of a result in a report with that decimal mark."""
    found = read_row(value, unit, source, name)
    return found and (found[int(comma_decimal)], found[2])


def read_units(results: DataFrame, unit_factors: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """One row per input row: result_id, doc_id, id, name, number, kind, common_unit, currency, factor, quantity.

    ``results`` has result_id, doc_id, id, name, value, unit and source_text.
    ``unit_factors`` is a short reference list that is read into the driver.
    ``languages`` (doc_id, lang) gives the reports' languages, which decide
    between 1.234 and 1,234 only. A null or absent value, or a unit that can't be
    told, leaves number or kind and quantity null; a multiplier alone takes the
    kind most frequent with its metric's name. Repeated rows stay repeated.
    """
    table = {r["unit_name"]: (r["kind"], r["common_unit"], float(r["factor"])) for r in unit_factors.select("unit_name", "kind", "common_unit", "factor").collect() if r["unit_name"] is not None}
    picked = results.select("result_id", "doc_id", "id", "name", "value", "unit", "source_text")
    schema = "result_id bigint, doc_id bigint, id string, name string, point double, comma double, readings array<struct<kind: string, common_unit: string, currency: string, factor: double, cost: double>>"
    reading = pa.struct([("kind", pa.string()), ("common_unit", pa.string()), ("currency", pa.string()), ("factor", pa.float64()), ("cost", pa.float64())])

    def in_common_units(told: tuple) -> list[tuple]:
        rows = []
        for unit_name, scale, money, times, cost in told:
            if unit_name is None:
                rows.append((None, None, None, times, cost))
            elif unit_name in table:
                kind, common, factor = table[unit_name]
                rows.append((kind, common, money, times * scale * factor, cost))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, list[tuple]] = {}
        for batch in batches:
            points, commas, offsets, flat = [], [], [0], []
            columns = batch.to_pydict()
            for name, value, unit, source in zip(*(columns[c] for c in ("name", "value", "unit", "source_text"))):
                found = read_row(value, unit, source, name)
                points.append(found and found[0])
                commas.append(found and found[1])
                if found and found[2]:
                    rows = memo.get(found[2])
                    if rows is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        rows = memo[found[2]] = in_common_units(found[2])
                    flat += rows
                offsets.append(len(flat))
            fields = [pa.array(list(c), f.type) for c, f in zip(zip(*flat) if flat else [[]] * 5, reading)]
            told = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(reading)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("result_id", "doc_id", "id", "name")), pa.array(points, pa.float64()), pa.array(commas, pa.float64()), told],
                names=["result_id", "doc_id", "id", "name", "point", "comma", "readings"],
            )

    # read once: the priors and the choice between readings both need it
    read = cut_lineage(picked.mapInArrow(run, schema))
    if languages is None:
        read = read.withColumn("number", F.col("point"))
    else:
        # the report's language meets the short rows that were read, not the texts; rows that it decides nothing in don't wait for it
        comma = languages.where(F.lower(F.substring(F.trim("lang"), 1, 2)).isin("de", "fr", "es", "it", "pt")).select(F.col("doc_id").alias("_doc")).distinct()
        open_ = F.col("point") != F.col("comma")
        decided = read.where(open_).join(comma, F.col("doc_id") == F.col("_doc"), "left").withColumn("number", F.when(F.col("_doc").isNotNull(), F.col("comma")).otherwise(F.col("point"))).drop("_doc")
        read = decided.unionByName(read.where(~F.coalesce(open_, F.lit(False))).withColumn("number", F.col("point")))
    cheapest = F.array_min(F.transform("readings", lambda r: r["cost"]))
    sure = read.select("name", F.filter("readings", lambda r: r["kind"].isNotNull() & (r["cost"] <= cheapest)).alias("r")).where((F.size("r") == 1)).select("name", F.col("r")[0]["kind"].alias("kind"), F.col("r")[0]["common_unit"].alias("common_unit"))
    counted = sure.groupBy("name", "kind", "common_unit").count()
    priors = counted.groupBy(F.col("name").alias("_name")).agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "count"))).alias("_seen"),
        F.max_by(F.struct("kind", "common_unit"), F.struct("count", "kind")).alias("_usual"), F.sum("count").alias("_all"),
    )
    scored = read.join(priors, F.col("name") == F.col("_name"), "left")

    def priced(r):
        kind = F.coalesce(r["kind"], F.col("_usual.kind"))
        share = (F.coalesce(F.try_element_at("_seen", kind), F.lit(0)) + 0.5) / (F.coalesce(F.col("_all"), F.lit(0)) + 1.0)
        common = F.coalesce(r["common_unit"], F.col("_usual.common_unit"))
        return F.struct((r["cost"] - F.log(share)).alias("price"), kind.alias("kind"), common.alias("common_unit"), r["currency"].alias("currency"), r["factor"].alias("factor"))

    chosen = scored.withColumn("_best", F.array_min(F.transform("readings", priced)))
    return chosen.select(
        "result_id", "doc_id", "id", "name", "number", F.col("_best.kind").alias("kind"), F.col("_best.common_unit").alias("common_unit"), F.col("_best.currency").alias("currency"),
        F.col("_best.factor").alias("factor"), F.when(F.col("_best.kind").isNotNull(), F.col("number") * F.col("_best.factor")).alias("quantity"),
    )


#: Logarithmic width of a bucket of quantities; wider than the tolerance, so equals lie in the same or the next bucket.
_WIDTH = 0.01


def same_quantities(read: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Pairs (result_id_a, result_id_b) of one doc_id and id that agree in the common unit but were recorded at different factors.

    Quantities are compared by bucket and once per distinct (quantity, factor),
    so neither a hot key nor many equal rows are paired with each other.
    """
    known = read.where((F.abs("quantity") < 1e300) & F.col("doc_id").isNotNull() & F.col("id").isNotNull() & ((F.col("kind") != "amount") | F.col("currency").isNotNull()))
    # short rows that four branches start from
    known = cut_lineage(known.select("result_id", "doc_id", "id", "kind", F.coalesce("currency", F.lit("")).alias("currency"), "quantity", "factor"))
    bucket = F.when(F.col("quantity") == 0, F.lit(-1_000_000)).otherwise(F.floor(F.log(F.abs("quantity")) / _WIDTH))
    key = ["doc_id", "id", "kind", "currency"]
    distinct = known.select(*key, "quantity", "factor").distinct().withColumn("_bucket", bucket).withColumn("_sign", F.signum("quantity"))
    left = distinct.withColumn("_bucket", F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1))).withColumnsRenamed({"quantity": "qa", "factor": "fa"})
    right = distinct.withColumnsRenamed({"quantity": "qb", "factor": "fb"})
    near = (F.abs(F.col("qa") - F.col("qb")) <= tolerance * F.greatest(F.abs("qa"), F.abs("qb"))) & (F.abs(F.col("fa") - F.col("fb")) > 1e-9 * F.greatest("fa", "fb"))
    agreeing = left.join(right, [*key, "_sign", "_bucket"]).where(near).select(*key, "qa", "fa", "qb", "fb")
    a = known.withColumnsRenamed({"result_id": "result_id_a", "quantity": "qa", "factor": "fa"})
    b = known.withColumnsRenamed({"result_id": "result_id_b", "quantity": "qb", "factor": "fb"})
    pairs = agreeing.join(a, [*key, "qa", "fa"]).join(b, [*key, "qb", "fb"]).where(F.col("result_id_a") < F.col("result_id_b"))
    return pairs.select("result_id_a", "result_id_b").distinct()
