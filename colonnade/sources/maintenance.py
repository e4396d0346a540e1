"""Compaction, vacuum and statistics of native tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import BOOL, I32, U32, UTF8
from .storage import BACKUP, SEGMENT_FILE, STAGING, Segment, Table, task_rows

_KINDS = (UTF8, I32, U32, BOOL)


@dataclass(frozen=True)
class CompactionReport:
    input_segments: int
    output_segments: int
    input_row_groups: int
    output_row_groups: int
    rows_rewritten: int
    bytes_before: int
    bytes_after: int
    skipped: bool


@dataclass(frozen=True)
class VacuumReport:
    removed_paths: tuple[str, ...]

    @property
    def removed_entries(self) -> int:
        return len(self.removed_paths)


def _totals(segments: list[Segment]) -> tuple[int, int, int, int]:
    return len(segments), sum(s.row_groups for s in segments), sum(s.rows for s in segments), sum(s.size_bytes for s in segments)


def needs_compaction(table: Table, segments: list[Segment] | None = None) -> bool:
    """Many segments, a segment of many row groups, or row groups that could be merged; and a rewrite that changes it."""
    segments = table.segments() if segments is None else segments
    c = table.config
    many = len(segments) >= c.compaction_segment_threshold or any(s.row_groups > c.compaction_row_group_threshold for s in segments)
    return bool(segments) and (many or any(s.underfilled for s in segments)) and not _optimal(table, segments)


def _optimal(table: Table, segments: list[Segment]) -> bool:
    """Whether a rewrite would give as many segments and row groups as there are."""
    count, groups, rows, _ = _totals(segments)
    size = table.config.row_group_size
    per_segment = size * table.config.compaction_row_group_threshold
    return count == max(1, -(-rows // per_segment)) and groups <= -(-rows // size) and not any(s.underfilled for s in segments)


def optimize(table: Table) -> CompactionReport:
    """Rewrites all rows into segments of row_group_size x compaction_row_group_threshold rows, in their order.

    Rows are dealt to tasks by their rank, without a sort of the table.
    """
    with table.lock():
        segments = table.segments()
        count, groups, rows, size = _totals(segments)
        if not segments or _optimal(table, segments):
            return CompactionReport(count, count, groups, groups, 0, size, size, True)
        per_segment = table.config.row_group_size * table.config.compaction_row_group_threshold
        # a task writes several segments, but under 1,000: the number of a task's file, by which they are sorted, has three digits
        df = table.dealt(table.scan(ordered=True), rows, per_segment, 999)
        written = table.replace(df, per_segment)
        after = table.segments()
        return CompactionReport(count, len(after), groups, sum(s.row_groups for s in after), written, size, sum(s.size_bytes for s in after), False)


def maybe_compact(table: Table) -> CompactionReport | None:
    return optimize(table) if needs_compaction(table) else None


def compact_segment(table: Table, segment: Segment) -> CompactionReport:
    """Rewrites one segment so that its row groups are full."""
    with table.lock():
        df = table.spark.read.schema(table.struct()).parquet(segment.path).coalesce(1)
        staged = f"{table.path}/{STAGING}one"
        table.files.delete(staged)
        rows = table._write(df, staged)
        name = segment.path.rsplit("/", 1)[1]
        table.swap([name], {name: staged})
        new = next(s for s in table.segments() if s.number == segment.number)
        return CompactionReport(1, 1, segment.row_groups, new.row_groups, rows, segment.size_bytes, new.size_bytes, False)


def vacuum(table: Table) -> VacuumReport:
    """Removes what interrupted writes and compactions left."""
    with table.lock():
        removed = []
        for e in table.files.list(table.path):
            unfinished = e.is_dir and e.name.startswith("segment_") and not table.files.exists(f"{e.path}/{SEGMENT_FILE}")
            if e.name.startswith((STAGING, BACKUP)) or unfinished:
                table.files.delete(e.path)
                removed.append(e.path)
        return VacuumReport(tuple(removed))


@dataclass(frozen=True)
class ColumnStats:
    name: str
    least: object
    most: object
    null_count: int
    distinct_sum: int


def column_stats(table) -> list[ColumnStats]:
    """Of each column: least and greatest value, nulls, and distinct values summed over row groups.

    A row group without any value counts no nulls. Columns that don't order (arrays) have no least and greatest.
    Least and greatest values are kept by no group, since Spark sorts rows to group texts. Distinct values are dealt out
    by their hash, column by column, so that a task has some task_rows(), but for those of one value in one row group.
    """
    df = table.scan()
    size = table.config.row_group_size if isinstance(table, Table) else 1 << 20
    fields = table.struct().fields
    columns = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)]
    if _has_files(table):
        file = F.col("_metadata.file_path")
        numbers = df.select(file.alias("__path")).distinct().selectExpr("__path", "row_number() over (order by __path) as __file")  # a row per file
        marked = df.select(*columns, file.alias("__path"), F.expr(f"_metadata.row_index div {size}").alias("__group"))
        grouped = marked.join(F.broadcast(numbers), "__path").drop("__path")
    else:
        grouped = df.select(*columns, F.lit(0).alias("__file"), F.lit(0).alias("__group"))
    orders = [f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary") for f in fields]
    ends = [x for i, o in enumerate(orders) for x in ((F.min(f"c{i}"), F.max(f"c{i}")) if o else (F.lit(None), F.lit(None)))]
    found = grouped.agg(F.count("*"), *ends).first()
    counts = grouped.groupBy("__file", "__group").agg(F.count("*").alias("n"), *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(fields))])
    nulls = counts.agg(F.count("*"), *[F.sum(F.when(F.col(f"n{i}") > 0, F.col("n") - F.col(f"n{i}"))) for i in range(len(fields))]).first()
    tasks = max(1, -(-found[0] // task_rows(found[0])))
    by = [(i, ["__file", "__group", f"c{i}"]) for i in range(len(fields))]
    each = [grouped.select(key).filter(f"c{i} is not null").repartition(tasks, *key).distinct().agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, key in by]
    distinct = {r["i"]: r["n"] for r in reduce(DataFrame.union, each).collect()}
    return [ColumnStats(f.name, found[1 + 2 * i], found[2 + 2 * i], int(nulls[1 + i] or 0), distinct[i]) for i, f in enumerate(fields)]


def _has_files(table) -> bool:
    return not isinstance(table, Table) or bool(table.segments())
