"""Assertions on data: they run one aggregate each and raise with a few examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    """A table breaks a rule that the next step relies on."""


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """V1: no two rows share ``keys`` (nulls count as a value). Returns ``df``."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise DataCheckError(f"duplicate keys {keys}: {[tuple(r)[:-1] for r in twice]}")
    return df


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """V2: a join neither lost nor multiplied rows. Returns ``after``."""
    a, b = before.count(), after.count()
    if a != b:
        raise DataCheckError(f"{a} rows became {b}")
    return after


def all_matched(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """V3: every left row has a right one. Returns ``left``."""
    lost = left.join(right.select(*keys).distinct(), list(keys), "left_anti").select(*keys).limit(3).collect()
    if lost:
        raise DataCheckError(f"no match for {[tuple(r) for r in lost]}")
    return left


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    bad = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    if any(bad):
        raise DataCheckError(f"nulls in {[c for c in cols if bad[c]]}")
    return df


def disjoint(a: DataFrame, b: DataFrame, *keys: str) -> None:
    """No value of ``keys`` is in both."""
    both = a.select(*keys).intersect(b.select(*keys)).limit(3).collect()
    if both:
        raise DataCheckError(f"in both: {[tuple(r) for r in both]}")


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows as often (U4)."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
