"""Order-insensitive comparison of a Spark result with a DuckDB oracle."""

from __future__ import annotations

import math

import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        s = str(v)
        return s[:10] if s.endswith("00:00:00") else s
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False)]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return cols, sorted(rows, key=key)


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> list[str]:
    """Problems found (empty list = equal)."""
    sc, srows = rows_of(spark_pdf)
    oc, orows = rows_of(oracle_pdf)
    if sc != oc:
        return [f"columns differ: spark-only={set(sc) - set(oc)} oracle-only={set(oc) - set(sc)}"]
    if len(srows) != len(orows):
        return [f"row count {len(srows)} vs {len(orows)}"]
    diffs = [(a, b) for a, b in zip(srows, orows) if a != b]
    if diffs:
        a, b = diffs[0]
        return [f"{len(diffs)} rows differ, e.g. {[(c, x, y) for c, x, y in zip(sc, a, b) if x != y][:4]}"]
    return []
