"""The four logical types, table schemas, and the strict coercions of written values."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError, SerializationError, StorageError, raised

UTF8, I32, U32, BOOL = "Utf8", "I32", "U32", "Bool"
#: Spellings in statements, in upper case.
SPELLINGS = {"UTF8": UTF8, "STRING": UTF8, "I32": I32, "INT": I32, "INT32": I32, "U32": U32, "UINT": U32, "UINT32": U32, "BOOL": BOOL, "BOOLEAN": BOOL}
SPARK = {UTF8: T.StringType(), I32: T.IntegerType(), U32: T.LongType(), BOOL: T.BooleanType()}
RANGES = {I32: (-(1 << 31), (1 << 31) - 1), U32: (0, (1 << 32) - 1)}
#: Spark has no unsigned integers: U32 is a LONG with this metadata.
U32_METADATA = {"logical_type": U32}
_INTEGER = re.compile(r"[+-]?[0-9]+", re.ASCII)
_TRUE, _FALSE = ("true", "1"), ("false", "0")


def parse_type(text: str) -> str:
    try:
        return SPELLINGS[text.upper()]
    except KeyError:
        raise ExecutionError(f"Unsupported column type: {text}") from None


def logical_type(field: T.StructField) -> str | None:
    """The logical type of a Spark column, None for a type that only external tables have."""
    if field.metadata.get("logical_type") == U32:
        return U32
    for name, spark in SPARK.items():
        if name != U32 and field.dataType == spark:
            return name
    return None


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    column_type: str
    nullable: bool = False

    def field(self) -> T.StructField:
        # Parquet readers give up NOT NULL; it is enforced when rows are written
        return T.StructField(self.name, SPARK[self.column_type], True, dict(U32_METADATA) if self.column_type == U32 else None)


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[ColumnSchema, ...]

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def to_json(self) -> str:
        return json.dumps({"columns": [{"name": c.name, "column_type": c.column_type, "nullable": c.nullable} for c in self.columns]}, indent=2)

    @staticmethod
    def from_json(text: str) -> TableSchema:
        try:
            return TableSchema(tuple(ColumnSchema(c["name"], c["column_type"], bool(c["nullable"])) for c in json.loads(text)["columns"]))
        except (ValueError, KeyError, TypeError) as e:
            raise SerializationError(f"Schema error: {e}") from None

    # --- values that the driver holds (row literals, protocol rows)

    def coerce_row(self, row: list) -> tuple:
        if len(row) != len(self.columns):
            raise StorageError(f"Row has {len(row)} values but schema requires {len(self.columns)}")
        return tuple(coerce(v, c) for v, c in zip(row, self.columns))


def coerce(value, column: ColumnSchema):
    """A value as the column stores it, by the rules of ``coerced``."""
    kind, name = column.column_type, column.name
    if value is None:
        if not column.nullable:
            raise StorageError(f"Column {name} is not nullable")
        return None
    if kind == UTF8:
        return ("true" if value else "false") if isinstance(value, bool) else str(value)
    if kind == BOOL:
        if isinstance(value, str):
            if value.lower() in _TRUE + _FALSE and value.isascii():
                return value.lower() in _TRUE
            raise StorageError(f"Value '{value}' cannot be parsed as Bool for column {name}")
        if value in (0, 1):
            return bool(value)
        raise StorageError(f"Column {name} expects Bool values")
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise StorageError(f"Column {name} expects {kind} values")
    low, high = RANGES[kind]
    if isinstance(value, str):
        if not _INTEGER.fullmatch(value) or (kind == U32 and value[0] == "-") or not low <= int(value) <= high:
            raise StorageError(f"Value '{value}' cannot be parsed as {kind} for column {name}")
        return int(value)
    if not low <= value <= high:
        raise StorageError(f"Value {value} does not fit in {kind} for column {name}")
    return value


# --- values inside Spark (JSON cells as variants)


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(raised(StorageError, message)))


def _failing(before: str, value: Column, after: str) -> Column:
    return F.raise_error(F.concat(F.lit("<<S|" + before), value, F.lit(after + ">>")))


def coerced(cell: Column, column: ColumnSchema) -> Column:
    """The stored value of a JSON cell (a variant, NULL where it is JSON's null); raises what a row of it would."""
    kind, name = column.column_type, column.name
    found = F.schema_of_variant(cell)
    text = F.try_variant_get(cell, "$", "string")
    integer = F.try_variant_get(cell, "$", "bigint")
    is_text, is_int, is_bool = found == "STRING", found == "BIGINT", found == "BOOLEAN"
    bad_number = _failing("Unsupported numeric value in ingest file: ", F.to_json(cell), "")
    bad_value = _failing("Unsupported value in ingest file: ", F.to_json(cell), "")
    is_number = is_int | found.startswith("DECIMAL") | found.isin("DOUBLE", "FLOAT")
    fits = is_int & (integer >= RANGES[I32][0]) & (integer <= RANGES[U32][1])
    nothing = F.lit(None).cast(SPARK[kind])
    null = nothing if column.nullable else _fail(f"Column {name} is not nullable").cast(SPARK[kind])

    if kind == UTF8:
        value = F.when(is_text, text).when(is_bool, F.try_variant_get(cell, "$", "boolean").cast("string")).otherwise(integer.cast("string"))
    elif kind == BOOL:
        low = F.lower(text)
        value = (
            F.when(is_bool, F.try_variant_get(cell, "$", "boolean"))
            .when(is_text & low.isin(*_TRUE), F.lit(True)).when(is_text & low.isin(*_FALSE), F.lit(False))
            .when(is_text, _failing("Value '", text, f"' cannot be parsed as Bool for column {name}").cast("boolean"))
            .when(integer.isin(0, 1), integer == 1).otherwise(_fail(f"Column {name} expects Bool values").cast("boolean"))
        )
    else:
        least, most = RANGES[kind]
        pattern = "^[+]?[0-9]+$" if kind == U32 else "^[+-]?[0-9]+$"
        number = F.when(is_text & text.rlike(pattern), text.try_cast("bigint"))
        value = (
            F.when(is_text & number.between(least, most), number)
            .when(is_text, _failing("Value '", text, f"' cannot be parsed as {kind} for column {name}").cast("bigint"))
            .when(is_bool, _fail(f"Column {name} expects {kind} values").cast("bigint"))
            .when(integer.between(least, most), integer)
            .otherwise(_failing("Value ", integer.cast("string"), f" does not fit in {kind} for column {name}").cast("bigint"))
        ).cast(SPARK[kind])
    return (
        F.when(cell.isNull() | (found == "VOID"), null)
        .when(is_number & ~fits, bad_number.cast(SPARK[kind]))
        .when(is_text | is_bool | is_int, value)
        .otherwise(bad_value.cast(SPARK[kind]))
    )
