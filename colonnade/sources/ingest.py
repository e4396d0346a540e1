"""JSON into tables: a file that is one array of rows, one row, or a row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError, raised
from ..functions.types import ColumnSchema, TableSchema, coerced


def _error(message: str) -> Column:
    return F.raise_error(F.lit(raised(StorageError, message))).cast("variant")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """One variant ``v`` per row of the file.

    Lines are read in parallel when the first that isn't blank is a JSON value and more follow; then the file can't be
    one JSON text. Else the file is parsed as a whole by one task, as one text must be.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.limit(2).collect()
    if not head:
        return spark.createDataFrame([], "value string").select(F.try_parse_json("value").alias("v"))
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).select(F.try_parse_json("value").isNotNull().alias("ok")).first()["ok"]
    if len(head) > 1 and first:
        parsed = F.try_parse_json("value")
        bad = F.raise_error(F.concat(F.lit("<<S|Invalid JSON line: "), F.col("value"), F.lit(">>"))).cast("variant")
        return lines.select(F.when(parsed.isNull(), bad).otherwise(parsed).alias("v"))
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("w"))
    kind = whole.select(F.schema_of_variant("w").alias("k")).first()["k"]
    if kind is None:
        raise StorageError(f"Invalid JSON line: {head[0]['value']}")
    if kind.startswith("ARRAY"):
        whole.createOrReplaceTempView("__colonnade_json")
        return spark.sql("select e.value as v from __colonnade_json, lateral variant_explode(w) as e")
    if kind.startswith("OBJECT"):
        return whole.withColumnRenamed("w", "v")
    raise StorageError(f"Expected a JSON array for ingest, got {head[0]['value']}")


def _cell(c: ColumnSchema, i: int) -> Column:
    """The variant of one column in a row that is an object (by name) or an array (by place)."""
    named = F.try_variant_get("v", f"$.{c.name}", "variant")
    if not c.nullable:
        missing = _error(f"Missing required field '{c.name}' in JSON row (column is NOT NULL)")
        named = F.when(named.isNull(), missing).otherwise(named)
    return F.when(F.col("kind") == "o", named).otherwise(F.try_variant_get("v", f"$[{i}]", "variant"))


def table_rows(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """Variants as rows of the schema, by its coercions; a bad row is an error when the result is written."""
    kind = F.schema_of_variant("v")
    n = len(schema.columns)
    size = F.size(F.try_variant_get("v", "$", "array<variant>"))
    arity = F.raise_error(F.concat(F.lit("<<S|JSON row has "), size.cast("string"), F.lit(f" values but schema requires {n}>>"))).cast("string")
    other = F.raise_error(F.concat(F.lit("<<S|Unsupported JSON row format: "), F.to_json("v"), F.lit(">>"))).cast("string")
    checked = F.when(kind.startswith("OBJECT"), F.lit("o")).when(kind.startswith("ARRAY") & (size == n), F.lit("a")).when(kind.startswith("ARRAY"), arity).otherwise(other)
    rows = rows.select("v", checked.alias("kind"))
    cells = rows.select("kind", *[_cell(c, i).alias(f"c{i}") for i, c in enumerate(schema.columns)])
    out = cells.select([coerced(F.col(f"c{i}"), c).alias(c.name) for i, c in enumerate(schema.columns)])
    return out.select([F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema.struct().fields])
