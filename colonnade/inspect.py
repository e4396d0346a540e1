"""The commands that describe databases, tables and plans. Their layouts are fixed values."""

from __future__ import annotations

from pathlib import Path

from .errors import ExecutionError
from .messages import MetaResult
from .plans.binder import bind
from .plans.formatter import format_logical, format_physical
from .plans.parser import Query, parse_statement
from .printer import box_table, section
from .sources.catalog import Catalog
from .sources.maintenance import column_stats, optimize, vacuum
from .sources.storage import ExternalTable, Table


def _rows(table: Table | ExternalTable) -> int:
    return sum(s.rows for s in table.segments()) if isinstance(table, Table) else table.scan().count()


def _shown(value) -> str:
    return "n/a" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def resident_bytes() -> int:
    """Memory of this process that is in RAM."""
    status = Path("/proc/self/status")
    if not status.exists():
        return 0
    return next((int(line.split()[1]) * 1024 for line in status.read_text().splitlines() if line.startswith("VmRSS:")), 0)


def databases(catalog: Catalog) -> str:
    tables = catalog.list_tables()
    found = catalog.list_databases()
    if not found:
        return "No databases found"
    out = []
    for d in found:
        own = [t for t in tables if t.database == d.name]
        n = sum(map(_rows, own))
        out.append([d.name, str(len(own)), str(n), "yes" if n else "no"])
    return box_table(["database", "tables", "rows", "has_data"], out)


def tables(catalog: Catalog, database: str | None) -> str:
    found = [t for t in catalog.list_tables() if database in (None, t.database)]
    if not found:
        return "No tables found"
    out = [[t.database, t.name, str(len(t.struct().fields)), str(n := _rows(t)), "yes" if n else "no"] for t in found]
    return box_table(["database", "table", "columns", "rows", "has_data"], out)


def schema(table: Table | ExternalTable) -> str:
    if isinstance(table, Table):
        columns = [f"  - {c.name}: {c.column_type}{' nullable' if c.nullable else ''}" for c in table.schema.columns]
    else:
        columns = [f"  - {f.name}: {f.dataType.simpleString()}{' nullable' if f.nullable else ''}" for f in table.struct().fields]
    return "\n".join([f"table: {table.fqn}", f"path: {table.path}", "columns:", *columns])


def segments(table: Table) -> str:
    lines = [f"segment_{i}\trows={s.rows}\trow_groups={s.row_groups}\tsize_bytes={s.size_bytes}\tcreated_at={s.created_at}" for i, s in enumerate(table.segments())]
    return "\n".join([f"table: {table.fqn}", *(lines or ["No segments found"])])


def storage(table: Table) -> str:
    c = table.config
    shown = {
        "compression": c.compression.capitalize(), "row_group_size": c.row_group_size, "dictionary_encoding": c.enable_dictionary_encoding, "bloom_filter": c.enable_bloom_filter,
        "compaction_segment_threshold": c.compaction_segment_threshold, "compaction_row_group_threshold": c.compaction_row_group_threshold,
        "background_compaction": c.enable_background_compaction, "background_compaction_interval_seconds": c.background_compaction_interval_seconds,
    }
    return "\n".join([f"table: {table.fqn}", *(f"{k}: {_shown(v)}" for k, v in shown.items())])


def stats(table: Table | ExternalTable) -> str:
    own = table.segments() if isinstance(table, Table) else []
    head = [f"table: {table.fqn}", f"segments: {len(own)}", f"row_groups: {sum(s.row_groups for s in own)}", f"rows: {_rows(table)}", f"size_bytes: {sum(s.size_bytes for s in own)}", "column_stats:"]
    return "\n".join([*head, *(f"  - {c.name}: min={_shown(c.least)} max={_shown(c.most)} null_count={c.null_count} row_group_distinct_sum={c.distinct_sum}" for c in column_stats(table))])


def optimized(table: Table) -> str:
    r = optimize(table)
    return "\n".join([
        f"table: {table.fqn}", f"input_segments: {r.input_segments}", f"output_segments: {r.output_segments}", f"input_row_groups: {r.input_row_groups}", f"output_row_groups: {r.output_row_groups}",
        f"rows_rewritten: {r.rows_rewritten}", f"size_bytes_before: {r.bytes_before}", f"size_bytes_after: {r.bytes_after}", f"skipped: {_shown(r.skipped)}",
    ])


def vacuumed(table: Table) -> str:
    r = vacuum(table)
    paths = ["removed_paths:", *(f"  - {p}" for p in r.removed_paths)] if r.removed_paths else ["removed_paths: none"]
    return "\n".join([f"table: {table.fqn}", f"removed_entries: {r.removed_entries}", *paths])


def explain(catalog: Catalog, text: str) -> str:
    found = parse_statement(text)
    if not isinstance(found, Query):
        raise ExecutionError("EXPLAIN currently only supports query statements")
    bound = bind(found.plan, catalog)
    return "\n\n".join([section("Logical Plan", format_logical(bound)), section("Physical Plan", format_physical(bound)), section("Server Summary", f"server_rss_bytes: {resident_bytes()}")])


#: Commands about one table: title, and what it shows.
_TABLE = {"schema": ("Schema", schema), "segments": ("Segments", segments), "storage": ("Storage", storage), "stats": ("Table Stats", stats), "optimize": ("Optimize", optimized), "vacuum": ("Vacuum", vacuumed)}
_NATIVE = ("segments", "storage", "optimize", "vacuum")


def run(catalog: Catalog, command: str) -> MetaResult:
    verb, rest = (*command.split(None, 1), "", "")[:2]
    verb, rest = verb.lower(), rest.strip()
    if verb == "databases":
        return MetaResult("Databases", databases(catalog))
    if verb == "tables":
        return MetaResult("Tables", tables(catalog, rest.split()[0] if rest else None))
    if verb == "explain":
        if not rest:
            raise ExecutionError("EXPLAIN requires an inline query")
        return MetaResult("Explain", explain(catalog, rest))
    if verb not in _TABLE:
        raise ExecutionError(f"Unknown meta command: {verb}")
    if not rest:
        raise ExecutionError(f"{verb} requires a table reference")
    title, show = _TABLE[verb]
    resolve = catalog.resolve_native if verb in _NATIVE else catalog.resolve
    return MetaResult(title, show(resolve(rest.split()[0])))
