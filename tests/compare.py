"""Order-insensitive comparison of two pandas frames."""

from __future__ import annotations

import datetime
import math

import pandas as pd


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.date, datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    try:
        return round(float(v), 9) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)
