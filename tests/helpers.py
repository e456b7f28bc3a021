"""Test helpers: compare DataFrames / pandas frames as multisets of rows."""

from __future__ import annotations

import math

import pandas as pd


def _norm(v, places=6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, places)
    if hasattr(v, "item"):
        return _norm(v.item(), places)
    return v


def rows(df, cols=None, places=6):
    pdf = df.toPandas() if not isinstance(df, pd.DataFrame) else df
    cols = cols or sorted(pdf.columns)
    out = [tuple(_norm(x, places) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=repr)
