"""Joins on keys that may be null, and names that no column has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where null keys equal each other.  For ``inner``, ``left``, ``full``, ``left_semi``
    and ``left_anti``; keys come once, as in a join by names."""
    on = list(on)
    names = {c: unused(left, f"{c}__right") for c in right.columns}
    other = right.select(*(F.col(f"`{c}`").alias(names[c]) for c in right.columns))
    col = lambda c: F.col(f"`{c}`")
    same: Column = reduce(lambda a, b: a & b, (col(k).eqNullSafe(col(names[k])) for k in on))
    out = left.join(other, same, how)
    if how in ("left_semi", "left_anti"):
        return out
    key = lambda k: (F.coalesce(col(k), col(names[k])) if how == "full" else col(k)).alias(k)
    rest = [col(c) for c in left.columns if c not in on] + [col(names[c]).alias(c) for c in right.columns if c not in on]
    return out.select(*(key(k) for k in on), *rest)
