"""Constraints as checks: each gives the rows that break it, so an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A table breaks a constraint."""


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in any of ``columns``."""
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.col(c).isNull()
    return df.where(broken)


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): values found more than once; a null equals nothing."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def primary_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n): keys with a null, or found more than once."""
    broken = F.col("n") > 1
    for c in columns:
        broken = broken | F.col(c).isNull()
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(broken)


def foreign_key(df: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``columns`` name no parent row; a row with a null among them names none and is allowed."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    known = parent.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)])
    return df.where(whole).join(known, [df[c] == known[f"_p{i}"] for i, c in enumerate(columns)], "left_anti")


def check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.where(~condition)


def require(broken: DataFrame, name: str) -> None:
    """Raise if any row breaks the constraint ``name``."""
    if not broken.isEmpty():
        raise ConstraintError(f"constraint {name} does not hold")
