"""Helpers of the tests."""

from __future__ import annotations

import math

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks outline_nodes metric_results profiles rules unit_factors".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if isinstance(value, (int, float)) else value


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(plain(v) for v in r)) for r in frame.itertuples(index=False))


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    left, right = rows(a), rows(b)
    assert len(left) == len(right)
    assert left == right
