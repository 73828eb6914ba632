"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas read it. ``use`` takes one parameter."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once a row: the optimiser copies no expression through a generator, however often and in
    whatever filters ``name`` is read above it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """Lower-cased words as ``str.lower().split()`` gives them."""
    return F.filter(F.split(F.lower(text), f"[{chars.WS}]+"), lambda w: w != "")


def case_words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{chars.WS}]+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{chars.WS}]+|[{chars.WS}]+$", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def which(text: Column, patterns: list[str], labels: list[str] | None = None, flags: str = "") -> Column:
    """Labels of the patterns that occur, in order; each pattern is a literal, so it compiles once a task."""
    found = [F.when(text.rlike(flags + chars.java(p)), F.lit(name)) for p, name in zip(patterns, labels or patterns)]
    return F.array_compact(F.array(*found))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))
