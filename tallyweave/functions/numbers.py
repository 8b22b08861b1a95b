"""Numbers as the pipeline itself reads them, without units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Words for no value.
NOTHING = ("null", "none", "", "n/a", "na", "—", "-")
_WIDE = "０１２３４５６７８９"


def parse_number(value: Column) -> Column:
    """First number of a text after thousands separators are dropped; ASCII parentheses around all of it negate.

    Neither exponents nor signs other than ASCII are read, and a year before a
    number is taken for it: the reading of ``value_num``.
    """
    text = strip(value)
    inside = text.startswith("(") & text.endswith(")")
    body = F.when(inside, F.substring(text, 2, F.length(text) - 2)).otherwise(text)
    digits = F.translate(F.translate(body, ",，", ""), _WIDE, "0123456789")
    found = F.regexp_extract(digits, r"-?\d+(?:\.\d+)?", 0)
    number = F.when(found != "", found.try_cast("double"))
    return F.when(value.isNull() | F.lower(text).isin(*NOTHING), F.lit(None).cast("double")).otherwise(F.when(inside & (number > 0), -number).otherwise(number))
