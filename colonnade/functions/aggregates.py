"""The five aggregates, with results that are never NULL and integer results that are checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError, raised
from .types import I32, RANGES, U32, logical_type

FUNCTIONS = ("SUM", "AVG", "MIN", "MAX", "COUNT")


@dataclass(frozen=True)
class Aggregation:
    """One aggregate of a column, as the helpers below make it."""

    func: str
    column: str

    def output_name(self) -> str:
        return f"{self.func.lower()}_{self.column}"


def sum_(column: str) -> Aggregation:
    return Aggregation("SUM", column)


def avg(column: str) -> Aggregation:
    return Aggregation("AVG", column)


def min_(column: str) -> Aggregation:
    return Aggregation("MIN", column)


def max_(column: str) -> Aggregation:
    return Aggregation("MAX", column)


def count(column: str) -> Aggregation:
    return Aggregation("COUNT", column)


def checked_i32(value: Column) -> Column:
    low, high = RANGES[I32]
    failed = F.raise_error(F.lit(raised(ExecutionError, "Aggregate result does not fit in I32")))
    return F.when(value.between(low, high), value).otherwise(failed.cast("bigint")).cast("int")


def aggregate(func: str, column: Column, field: T.StructField) -> tuple[Column, T.DataType]:
    """The aggregate and the type of its result.

    I32 and U32 inputs give a checked INT, LONG ones BIGINT and DOUBLE ones DOUBLE; groups without a value give 0.
    AVG of integers truncates toward zero. COUNT takes any type.
    """
    kind = logical_type(field)
    if func == "COUNT":
        n = F.count(column)
        return (n, T.LongType()) if isinstance(field.dataType, (T.LongType, T.DoubleType)) and kind != U32 else (checked_i32(n), T.IntegerType())
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        f = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[func]
        return F.coalesce(f(column), F.lit(0.0)).cast("double"), T.DoubleType()
    if kind not in (I32, U32) and not isinstance(field.dataType, T.LongType):
        raise ExecutionError("Grouped aggregation only supports I32 and U32 inputs")
    if func == "AVG":
        total, n = F.coalesce(F.sum(column.cast("bigint")), F.lit(0)), F.count(column)
        # sum div n, with 0 where there is nothing to divide by; DIV truncates toward zero
        value = F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", total, n))
    else:
        f = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[func]
        value = F.coalesce(f(column.cast("bigint")), F.lit(0).cast("bigint"))
    return (checked_i32(value), T.IntegerType()) if kind in (I32, U32) else (value, T.LongType())


# --- library aggregates beside the query path


def global_aggregate(df: DataFrame, column: str, func: str) -> int | float:
    """One aggregate over all rows; AVG is a float, MIN and MAX of nothing are errors."""
    if column not in df.columns:
        raise ExecutionError(f"Unknown column: {column}")
    c = F.col(f"`{column}`")
    f = {"SUM": F.coalesce(F.sum(c), F.lit(0)), "COUNT": F.count(c), "AVG": F.coalesce(F.avg(c), F.lit(0.0)), "MIN": F.min(c), "MAX": F.max(c)}
    value = df.agg(f[func]).first()[0]
    if value is None:
        raise ExecutionError(f"{func} on empty input")
    return value


def group_by_multi_key(df: DataFrame, keys: list[str], column: str, func: str) -> DataFrame:
    """Groups by the keys as text (NULL is the text ``NULL``); groups without a value vanish. Result column ``result``."""
    for k in keys:
        if k not in df.columns:
            raise ExecutionError(f"Unknown key column: {k}")
    if column not in df.columns:
        raise ExecutionError(f"Unknown agg column: {column}")
    c = F.col(f"`{column}`")
    f = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[func]
    named = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("NULL")).alias(k) for k in keys]
    return df.filter(c.isNotNull()).groupBy(*named).agg(f(c).alias("result"))
