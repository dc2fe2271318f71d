"""The few functions that Spark has no expression for, as Arrow-batched UDFs. Apply them to distinct values."""

from __future__ import annotations

import base64
import difflib
import gzip
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def plain_letters(texts: pd.Series) -> pd.Series:
    """Letters without their marks (NFKD)."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def packed(texts: pd.Series) -> pd.Series:
    """gzip, then base64; the same text always packs the same way."""
    return texts.map(lambda t: None if t is None else base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


@F.pandas_udf(StringType())
def unpacked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else gzip.decompress(base64.b64decode(t)).decode())


@F.pandas_udf(DoubleType())
def name_ratio(known: pd.Series, typed: pd.Series) -> pd.Series:
    """How alike two names are by their matching blocks, from 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, k, t).ratio() for k, t in zip(known, typed, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def simplified(lines: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Douglas-Peucker on 'x y,x y,...'; both ends stay."""

    def one(line, bound):
        if not line:
            return line
        points = [tuple(map(float, p.split())) for p in line.split(",")]
        keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
        while stack:
            a, b = stack.pop()
            (x1, y1), (x2, y2) = points[a], points[b]
            length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
            worst, at = 0.0, None
            for k in range(a + 1, b):
                x, y = points[k]
                off = abs((y2 - y1) * x - (x2 - x1) * y + x2 * y1 - y2 * x1) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
                if off > worst:
                    worst, at = off, k
            if at is not None and worst > bound:
                keep.add(at)
                stack += [(a, at), (at, b)]
        return ",".join(f"{points[k][0]:.6f} {points[k][1]:.6f}" for k in sorted(keep))

    return pd.Series([one(t, b) for t, b in zip(lines, tolerance, strict=True)])
