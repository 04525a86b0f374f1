"""Arrow UDFs for what Catalyst has no function for: Unicode folding and edit ratios."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def fold(text: str) -> str:
    """NFKC, case folded, without any white space."""
    return "".join(unicodedata.normalize("NFKC", text).casefold().split())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & masks.get(c, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common / (length of both); 100 for two empty texts."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def best_window_ratio(a: str, b: str) -> float:
    """indel_ratio of the shorter text and the best window of at most its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, w) for w in windows)


def _each(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def _mapped(function):
    def run(names: pd.Series) -> pd.Series:
        return names.map(function, na_action="ignore")

    return run


# the UDFs are made where they are used: making one needs a session, importing this module doesn't


def normalized_name(name):
    return F.pandas_udf(_mapped(fold), "string")(name)


def comparison_name(name):
    return F.pandas_udf(_mapped(lambda x: "".join(c for c in fold(x) if c.isalnum())), "string")(name)


def display_name(name):
    return F.pandas_udf(_mapped(lambda x: " ".join(unicodedata.normalize("NFKC", x).split())), "string")(name)


def ratio(a, b):
    return F.pandas_udf(_each(indel_ratio), "double")(a, b)


def partial_ratio(a, b):
    return F.pandas_udf(_each(best_window_ratio), "double")(a, b)


def title_score(a: str, b: str, at_least: float = 0) -> float | None:
    """difflib's ratio; None where the characters that both have show that it is below the limit."""
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() * 100 if not at_least or m.quick_ratio() * 100 >= at_least else None


def title_ratio(a, b, at_least: float = 0):
    """difflib's ratio; the order of the arguments matters. Null where it is seen early that it is below the limit."""
    return F.pandas_udf(_each(lambda x, y: title_score(x, y, at_least)), "double")(a, b)
