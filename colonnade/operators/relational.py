"""Relational operators on DataFrames with the engine's semantics. Names are exact and may hold dots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """A comparison with NULL is not true, as everywhere in SQL."""
    return df.filter(predicate)


def project(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Columns (from, to) in order; duplicates are allowed."""
    return df.select([column(a).alias(b) for a, b in columns])


def join_null_safe(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Inner equi-join in which NULL keys match each other; left columns, then right ones.

    The names of the two sides must differ. Spark plans it as an equi-join on (coalesce(key), key is null) and
    picks a broadcast or a sort-merge join, whose skewed partitions adaptive execution splits.
    """
    return left.join(right, column(left_on).eqNullSafe(column(right_on)), "inner")


def group(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """One row per group, NULL being a group like any other; without keys one row for all."""
    return df.groupBy([column(k) for k in keys]).agg(value.alias(name))


def ordering(names: list[tuple[str, bool]]) -> list[Column]:
    """Ascending puts nulls last, descending first: (name, descending) to Spark's sort columns."""
    return [column(n).desc_nulls_first() if down else column(n).asc_nulls_last() for n, down in names]


def sort(df: DataFrame, names: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*ordering(names))


def limit(df: DataFrame, n: int | None, offset: int) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if n is None else df.limit(n)


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
