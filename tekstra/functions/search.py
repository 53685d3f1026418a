"""Where a row lies among sorted bounds: halving steps over one constant of the plan, whatever their number."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(n: int) -> Column:
    return F.array(*(F.lit(1 << p) for p in range(n.bit_length(), -1, -1)))


def _pairs(bounds: list[tuple[int, int]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in bounds])), "array<struct<a:bigint,b:bigint>>")


def _pair(first: str, second: str) -> Column:
    return F.struct(F.col(first).alias("a"), F.col(second).alias("b"))


def _count_upto(known: Column, n: int, key: Column) -> Column:
    return F.aggregate(_steps(n), F.lit(0), lambda acc, step: F.when(F.get(known, acc + step - 1) <= key, acc + step).otherwise(acc))


def pairs_upto(bounds: list[tuple[int, int]], first: str, second: str) -> Column:
    """How many of the sorted pairs are at or before (first, second)."""
    return _count_upto(_pairs(bounds), len(bounds), _pair(first, second))


def pair_at(bounds: list[tuple[int, int]], place: Column, first: str, second: str) -> Column:
    """Whether (first, second) is the pair at that place (from 0)."""
    return F.coalesce(F.get(_pairs(bounds), place) == _pair(first, second), F.lit(False))


def numbers_upto(bounds: list[int | float], value: str) -> Column:
    """How many of the sorted numbers are at or before the value."""
    kind = "double" if any(isinstance(b, float) for b in bounds) else "bigint"
    return _count_upto(F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>"), len(bounds), F.col(value))
