"""Bound plans to DataFrames. Pruning, pushdown, join strategy, partial aggregation and spill are Catalyst's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..operators import relational as R
from . import logical as L
from .binder import Bound
from .expr import ColumnRef, Comparison, Expr, Literal, Logical


def predicate(e: Expr) -> Column:
    if isinstance(e, ColumnRef):
        return R.column(e.name)
    if isinstance(e, Literal):
        return F.lit(e.value)
    left, right = predicate(e.left), predicate(e.right)
    if isinstance(e, Logical):
        return left & right if e.op == "AND" else left | right
    assert isinstance(e, Comparison)
    return left == right if e.op == "=" else left > right if e.op == ">" else left < right


def compile_plan(bound: Bound) -> DataFrame:
    return _compile(bound, False)[0]


def _compile(bound: Bound, ordered: bool, enough: int | None = None) -> tuple[DataFrame, list[str]]:
    """The DataFrame, and hidden columns that give the rows' place in the tables if ``ordered`` asks for it.

    ``enough``: so many first rows will do; a table then reads no more segments than have them.

    Only a LIMIT or OFFSET without ORDER BY asks: it takes the first rows in the order of the scan, or the first
    groups in the order of their keys.
    """
    node = bound.node
    if isinstance(node, L.Scan):
        df = bound.table.scan(ordered, enough)
        return df, [c for c in df.columns if c.startswith("__at_")] if ordered else []
    if isinstance(node, L.Join):
        return _join(bound, ordered)
    if isinstance(node, L.Limit):
        child = bound.children[0]
        sorted_below = isinstance(child.node, L.Sort)
        df, hidden = _compile(child, not sorted_below, None if node.n is None else node.n + node.offset)
        if not sorted_below:
            if hidden:
                df = R.sort(df, [(h, False) for h in hidden])
            df = R.limit(df, node.n, node.offset)
            return df.drop(*hidden), []
        return R.limit(df, node.n, node.offset), []
    if isinstance(node, L.Sort):
        return _sort(bound), []
    child = bound.children[0]
    df, hidden = _compile(child, ordered, enough if isinstance(node, L.Project) else None)
    if isinstance(node, (L.Filter, L.GroupFilter)):
        return R.filter_rows(df, predicate(node.predicate)), hidden
    if isinstance(node, L.Project):
        return R.project(df, [*node.columns, *[(h, h) for h in hidden]]), hidden
    value, _ = aggregate(node.func, R.column(node.column), child.field(node.column))
    name = bound.active[2]
    out = R.group(df, list(node.keys), value, name)
    if not ordered:
        return out, []
    # first key first, nulls last; the other keys make the order of ties certain
    marks = [f"__at_{i}" for i in range(len(node.keys))]
    return out.select("*", *[R.column(k).alias(m) for k, m in zip(node.keys, marks)]), marks


def _join(bound: Bound, ordered: bool) -> tuple[DataFrame, list[str]]:
    sides, hidden = [], []
    fields = iter(bound.output)
    for tag, child in zip("lr", bound.children):
        df, marks = _compile(child, ordered)
        renamed = [R.column(f.name).alias(next(fields).name, metadata=f.metadata) for f in child.output]
        new = [f"__at_{tag}{m[5:]}" for m in marks]
        sides.append(df.select(*renamed, *[R.column(a).alias(b) for a, b in zip(marks, new)]))
        hidden += new
    node = bound.node
    left, right = sides
    same = set(left.columns) & set(right.columns)
    if same:
        # a self-join: names stay as they are, so only the key is told apart while it is compared
        left, right = left.alias("l"), right.alias("r")
        on = F.col(f"l.`{node.left_on}`").eqNullSafe(F.col(f"r.`{node.right_on}`"))
        return left.join(right, on, "inner"), hidden
    return R.join_null_safe(left, right, node.left_on, node.right_on), hidden


def _sort(bound: Bound) -> DataFrame:
    """Sorts before a projection, so that it may leave out the aggregate that it sorts by."""
    child = bound.children[0]
    terms = [(t.expr.name, t.descending) for t in bound.node.order]
    if not isinstance(child.node, L.Project):
        return R.sort(_compile(child, False)[0], terms)
    source = {to: name for name, to in reversed(child.node.columns)}
    below = [(source.get(name, name), down) for name, down in terms]
    df = R.sort(_compile(child.children[0], False)[0], below)
    return R.project(df, list(child.node.columns))
