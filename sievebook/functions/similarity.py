"""Jaro-Winkler and name scores as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler(a: str, b: str) -> float:
    """1 for equal texts, 0 if one is empty; transpositions are halved without rounding; the prefix bonus has no threshold."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def name_score(query: list[str], name: list[str]) -> float:
    """Each query token takes the best unused token of the name, if alike by 0.8; 0.85 of the mean likeness and 0.15 of the share of the name taken."""
    if not len(query) or not len(name):
        return 0.0
    free, total, taken = [True] * len(name), 0.0, 0
    for q in query:
        best, at = 0.0, -1
        for i, t in enumerate(name):
            if free[i]:
                s = float(q == t) if len(q) <= 2 or len(t) <= 2 else jaro_winkler(q, t)
                if s > best:
                    best, at = s, i
        total += best
        if at >= 0 and best >= 0.8:
            free[at] = False
            taken += 1
    return 0.85 * total / len(query) + 0.15 * taken / len(name)


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([jaro_winkler(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def name_score_udf(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([name_score(list(x), list(y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")
