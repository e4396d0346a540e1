"""Results as text: box tables, delimited lines, and the sections of a query's answer. The layouts are fixed values."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from .messages import Error, MetaResult, Ok, Pong, QueryResult, ResultSet

FORMATS = ("unicode", "ascii", "csv", "tsv")
#: Corners and crossings of the top, middle and bottom border, then the horizontal and vertical line.
_BOXES = {"unicode": ("┌┬┐", "├┼┤", "└┴┘", "─", "│"), "ascii": ("+++", "+++", "+++", "-", "|")}


@dataclass
class Settings:
    show_timing: bool = False
    show_plan: bool = True
    show_profile: bool = False
    output_format: str = "unicode"


def width(text: str) -> int:
    """Columns of a terminal that a text takes."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Cc") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def footer(n: int) -> str:
    return f"({n} row)" if n == 1 else f"({n} rows)"


def box_table(columns: list[str], rows: list[list[str]], style: str = "ascii") -> str:
    if not columns:
        return f"({len(rows)} rows)"
    top, middle, bottom, across, down = _BOXES[style]
    widths = [max([width(c), *(width(r[i]) for r in rows if i < len(r))]) for i, c in enumerate(columns)]

    def border(marks: str) -> str:
        return marks[0] + marks[1].join(across * (w + 2) for w in widths) + marks[2]

    def line(values: list[str]) -> str:
        cells = [values[i] if i < len(values) else "" for i in range(len(widths))]
        return down + down.join(f" {c}{' ' * (w - width(c))} " for c, w in zip(cells, widths)) + down

    return "\n".join([border(top), line(columns), border(middle), *map(line, rows), border(bottom), footer(len(rows))])


def result_set(result: ResultSet, style: str) -> str:
    if style in _BOXES:
        return box_table(result.columns, result.rows, style)
    mark = "," if style == "csv" else "\t"
    return "\n".join([mark.join(result.columns), *(mark.join(r) for r in result.rows), footer(len(result.rows))])


def section(title: str, content: str) -> str:
    return f"=== {title} ===\n{content}"


def query_result(q: QueryResult, elapsed_ms: float, response_bytes: int, settings: Settings) -> str:
    s = q.summary
    lines = [f"rows: {s.rows}", f"columns: {s.columns}", f"batches: {s.batches}", f"server_execution_ms: {s.execution_time_ms:.3f}"]
    if settings.show_timing or settings.show_profile:
        lines.append(f"client_round_trip_ms: {elapsed_ms:.3f}")
    if settings.show_profile:
        lines.append(f"response_bytes: {response_bytes}")
    parts = [section("Query Summary", "\n".join(lines))]
    if settings.show_plan:
        parts += [section("Logical Plan", q.logical_plan), section("Physical Plan", q.physical_plan)]
    return "\n\n".join([*parts, section("Query Results", result_set(q.result_set, settings.output_format))])


def response(message, elapsed_ms: float, response_bytes: int, settings: Settings) -> str:
    if isinstance(message, QueryResult):
        return query_result(message, elapsed_ms, response_bytes, settings)
    text = {Ok: lambda m: m.message, Error: lambda m: f"Error: {m.message}", Pong: lambda m: "PONG", MetaResult: lambda m: f"{m.title}\n{m.content}"}[type(message)](message)
    if settings.show_profile:
        text += f"\nprofile: elapsed={elapsed_ms:.3f} ms, response_bytes={response_bytes}"
    elif settings.show_timing:
        text += f"\ntime: {elapsed_ms:.3f} ms"
    return text
