"""Column-name rules and the name-similarity function."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(raw: str) -> str:
    """Lower-case, spaces to underscores, only letters, digits and underscores (Unicode aware)."""
    joined = "_".join(str(raw).strip().lower().split(" "))
    return "".join(ch for ch in joined if ch == "_" or ch.isalnum())


def unique_names(names: list) -> list:
    """Number repeated names ``x, x_2, x_3`` without colliding with names already there."""
    taken, seen, out = set(names), {}, []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        if seen[name] > 1:
            n = seen[name]
            while f"{name}_{n}" in taken:
                n += 1
            seen[name] = n
            name = f"{name}_{n}"
            taken.add(name)
        out.append(name)
    return out


@lru_cache(maxsize=1 << 16)
def name_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two names, 0..1; ``a`` first, since it is not symmetric."""
    return SequenceMatcher(None, a, b).ratio()


def letter_counts(names: list) -> np.ndarray:
    """One row per name: how often each character of any of the names occurs in it."""
    places = {c: i for i, c in enumerate(sorted(set("".join(names))))}
    out = np.zeros((len(names), len(places) or 1), np.int32)
    for i, name in enumerate(names):
        for c in name:
            out[i, places[c]] += 1
    return out


def best_of(left: list, right: list, ratio=name_ratio) -> list:
    """For each name of ``left`` its best ratio against ``right``, with few exact ratios.

    Matching blocks use a character at most as often as both names hold it, so twice the shared characters over all characters is never below
    the ratio. Candidates are taken by that bound, the highest first, until it is no better than the best ratio found.
    """
    left, right = list(left), list(right)
    if not right:
        return [0.0] * len(left)
    known: dict = {}
    others = sorted(set(right))
    mine = sorted(set(left))
    counts = letter_counts([*mine, *others])
    sizes = counts.sum(1)
    for i, x in enumerate(mine):
        if x in set(right):
            known[x] = 1.0
            continue
        shared = np.minimum(counts[i], counts[len(mine):]).sum(1)
        total = sizes[i] + sizes[len(mine):]
        bound = np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
        best = 0.0
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] <= best:
                break
            best = max(best, ratio(x, others[k]))
        known[x] = best
    return [known[x] for x in left]


def ratio_bound(x: Column, y: Column) -> Column:
    """The same bound as a column expression: twice the characters that two texts share over all their characters; 1 for two empty ones."""
    def times(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    letters = F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")
    shared = F.aggregate(letters, F.lit(0), lambda total, c: total + F.least(times(x, c), times(y, c)))
    return F.coalesce(F.try_divide(2.0 * shared, (F.length(x) + F.length(y)).cast("double")), F.lit(1.0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_ratios(names_a: pd.Series, names_b: pd.Series) -> pd.Series:
    """Per row: for each name of the first array the best ratio against the second array."""
    return pd.Series([best_of(left, right) for left, right in zip(names_a, names_b)])
