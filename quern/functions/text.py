"""Scalar functions on texts and sets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def phone_matches(a: Column, b: Column) -> Column:
    """Equal last digits, as many as the shorter has; null unless both have some."""
    x, y = digits_only(a), digits_only(b)
    n = F.least(F.length(x), F.length(y))
    return F.when(n > 0, F.right(x, n) == F.right(y, n))


def term_set(text: Column, sep: str = "|") -> Column:
    """Distinct trimmed lower-case parts, blanks left out."""
    parts = F.transform(F.split(text, "[" + sep + "]"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Null when both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def dedup_lines(text: Column) -> Column:
    """Stripped non-blank lines, each at its first place only."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(x))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of trimmed lower-case texts; null counts as empty."""
    clean = lambda s: "" if s is None else s.strip().lower()
    return pd.Series([difflib.SequenceMatcher(None, clean(x), clean(y)).ratio() for x, y in zip(a, b)], dtype="float64")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval, clamped to 0..1; (0, 0) without observations."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = hits / m, z * z
    mid = (p + zz / (2 * m)) / (1 + zz / m)
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / (1 + zz / m)
    some = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return some(F.greatest(F.lit(0.0), mid - half)), some(F.least(F.lit(1.0), mid + half))
