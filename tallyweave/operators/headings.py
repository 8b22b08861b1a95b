"""Heading levels from numbering, by language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, strip

# Sections that open a report's first level in English.
ENGLISH_SECTIONS = (
    r"important notice|contents?|chairman'?s statement|company information|financial highlights?|five[- ]year (?:financial )?summary|management discussion and analysis|business review"
    r"|directors'? report|report of the directors?|report of the (?:board of )?supervisors?|corporate governance(?: report)?|environmental,? social and governance(?: report)?|esg report"
    r"|directors,? supervisors and senior management|profiles? of directors|changes in share capital|substantial shareholders?|independent auditor'?s report|report on the audit"
    r"|consolidated statement of profit or loss|consolidated income statement|consolidated statement of comprehensive income|consolidated statement of financial position|consolidated balance sheet"
    r"|consolidated statement of changes in equity|consolidated statement of cash flows?|notes? to the (?:consolidated )?financial statements|definitions?|glossary"
)
# Numbering patterns in the order in which they are tried, with their level. Spelled for Java and RE2 alike.
NUMBERING = {
    "zh": [
        (r"^第[一二三四五六七八九十百]+节", 1),
        (r"^[一二三四五六七八九十百]+[、\s]", 1),
        (r"^[（(][一二三四五六七八九十]+[）)]", 2),
        (r"^\d+\.\d+", 4),
        (r"^[（(]\d+[）)]", 4),
        (r"^\d+[\s、\.]", 3),
    ],
    "en": [
        (rf"(?i)^\s*(?:section\s+[ivxlcdm]+\s*[:.\-]?\s*)?(?:{ENGLISH_SECTIONS})\b", 1),
        (r"(?i)^(?:section|part|chapter)\s+(?:[ivxlcdm]+|\d+)\b", 1),
        (r"^\d{1,2}\.\d{1,2}\.\d{1,2}", 4),
        (r"(?i)^note\s+\d+", 4),
        (r"^\d{1,2}\.\d{1,2}(?:\D|$)", 3),
        (r"(?i)^[（(][a-z0-9]{1,3}[）)]\s*\S", 3),
        (r"^(?:\d{1,2}|[IVXivx]{1,4}|[A-H])[\.\)]\s+\S", 2),
    ],
}
#: Longest plain line that is promoted to a heading.
LONGEST = {"zh": 40, "en": 90}
MARKER = r"^\s*#\s*---.*---\s*$"


def numbering_level(text: Column, language: str = "zh") -> Column:
    """Level that a title's numbering gives, 0 for none."""
    rules = NUMBERING["en" if language == "en" else "zh"]
    return reduce(lambda rest, rule: F.when(text.rlike(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(0))


def relevel_line(line: Column, language: str = "zh", promote: bool = False, longest: int = 0) -> Column:
    """One line with its heading level set; slice markers and, unless promoted, plain lines stay as they are."""
    title = strip(F.regexp_replace(strip(F.regexp_replace(line, r"^#{1,6}\s*", "")), r"^\*\*(.*)\*\*$", "$1"))
    level = numbering_level(title, language)
    heading = line.rlike(r"^#{1,6}") & (title != "")
    set_heading = F.concat(F.repeat(F.lit("#"), F.when(level == 0, 2).otherwise(level)), F.lit(" "), title)
    out = F.when(line.rlike(MARKER), line).when(heading, set_heading)
    if promote:
        bare = strip(line)
        own = numbering_level(bare, language)
        most = longest or LONGEST["en" if language == "en" else "zh"]
        out = out.when((bare != "") & ~bare.contains("|") & (F.length(bare) <= most) & (own > 0), F.concat(F.repeat(F.lit("#"), own), F.lit(" "), bare))
    return out.otherwise(line)


def relevel(df: DataFrame, text: str = "text", language: str = "zh", promote: bool = False, longest: int = 0) -> DataFrame:
    """``df`` with the column re-levelled line by line, inside the row. Null stays null."""
    lines = F.transform(lines_of(F.col(text)), lambda line: relevel_line(line, language, promote, longest))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(lines, "\n")))


def heading_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?m)^#{1,6}\s"))
