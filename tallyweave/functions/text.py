"""Text functions as column expressions; Arrow functions only where Spark has no expression."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the wide sense, and what ends a line; both spelled so that Java and RE2 read them alike.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"(?:\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])"

# The marker lines that a page-sliced recognition writes, strict and universal.
SLICE_STRICT = r"^\s*#\s*---\s*PDF\s*物理切片\s*[:：]\s*第\s*(\d+)\s*-\s*(\d+)\s*页\s*---\s*$"
SLICE_ANY = r"(?i)^\s*#\s*---.*?(?:第|Pages?)\s*(\d+)\s*-\s*(\d+)\s*(?:页)?.*?---\s*$"
#: The same with the groups left out, to test a line.
SLICE_LINE = r"(?i)^\s*#\s*---.*(?:第|Pages?)\s*\d+\s*-\s*\d+\s*(?:页)?.*---\s*$"


#: The characters of SPACE.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at either end; trimmed from the ends, so a long text costs no more than a short one."""
    return F.btrim(c, F.lit(SPACES))


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts have none, and no empty line follows the last line end."""
    body = F.regexp_replace(text, f"{LINE_END}\\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks; plain ASCII passes through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def squeeze(c: Column) -> Column:
    """Lower case without any white space; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE, "")


def match_form(c: Column) -> Column:
    """The form in which terms and texts are compared: composed, lower case, no white space."""
    return squeeze(nfkc(F.coalesce(c, F.lit(""))))


def either_of(term: Column) -> Column:
    """Alternatives of a term: parts between slashes, or the term itself if there are none but it isn't empty."""
    parts = F.filter(F.transform(F.split(term, "/"), strip), lambda x: x != "")
    whole = strip(term)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(whole))


# What counts as yes in a rule cell.
YES = ("true", "1", "yes", "y", "是", "√", "✓", "t")


def parse_bool(c: Column, default: bool) -> Column:
    bare = F.lower(strip(c))
    return F.when(c.isNull() | (bare == ""), F.lit(default)).otherwise(bare.isin(*YES))


def parse_list(c: Column) -> Column:
    """Entries of a list cell, between commas and semicolons of either width and line ends."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\n；;，]", ","), ","), strip)
    return F.filter(parts, lambda x: x != "")


def strip_inline_markdown(c: Column) -> Column:
    """Text without images' marks, links, bold, italics and code ticks."""
    steps = [(r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`([^`]*)`", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1")]
    return strip(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def word_form(c: Column) -> Column:
    """Letters, digits and underscores only, lower case: how blocks and anchors are compared."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]", ""))


def absent(c: Column) -> Column:
    """Null, empty, or the word null; zero is present."""
    return F.coalesce(c.isin("", "null"), F.lit(True))


def value_with_unit(value: Column, unit: Column) -> Column:
    """The cell of a comparison: value and unit, empty if the value is absent."""
    return F.when(absent(value), F.lit("")).otherwise(F.concat_ws(" ", value, F.nullif(unit, F.lit(""))))


def display_width(c: Column) -> Column:
    """Column width: ideographs count 1.8."""
    text = F.coalesce(c, F.lit(""))
    return F.length(text) + 0.8 * F.regexp_count(text, F.lit("[一-鿿]"))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")), r'[\\/:*?"<>|\s]+', "_")


def safe_sheet_base(c: Column, width: int = 31) -> Column:
    """A sheet name without forbidden signs and not too long; empty gives ``Sheet``."""
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(c, r"[\\/*?:\[\]]", "_")), 1, width), F.lit("")), F.lit("Sheet"))


def escape_html(c: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings, regardless of case; ``*`` also matches ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def signature(*parts: Column) -> Column:
    """First twelve hexadecimal digits of the parts' digest."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def search_window(year: Column) -> Column:
    """Dates between which the report of a year is announced."""
    return F.concat(year.cast("string"), F.lit("-01-01~"), (year + 1).cast("string"), F.lit("-06-30"))
