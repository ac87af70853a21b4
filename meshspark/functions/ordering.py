"""Stable sorts, top values and the small integer helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 1000


def sort_desc(df: DataFrame, value: str, position: str) -> DataFrame:
    """Descending by value; equal values keep the order of ``position``."""
    return df.orderBy(F.col(value).desc(), F.col(position).asc())


def sort_asc(df: DataFrame, value: str, position: str) -> DataFrame:
    return df.orderBy(F.col(value).asc(), F.col(position).asc())


def top_values(df: DataFrame, value: str, n: int = TOP) -> DataFrame:
    """The n largest values, without ids, largest first."""
    return df.select(value).orderBy(F.col(value).desc()).limit(n)


def midpoint(a: Column, b: Column) -> Column:
    """Mean of two integers, rounded down, that can't overflow."""
    odd = a.bitwiseAND(F.lit(1)) + b.bitwiseAND(F.lit(1))
    return F.shiftright(a, 1) + F.shiftright(b, 1) + F.floor(odd / 2).cast("long")


def pow2_floor(n: int) -> int:
    """Largest power of two up to n; 4 for 0."""
    return 1 << (n.bit_length() - 1) if n > 0 else 4
