"""Logical plans: eight nodes that compose freely, and the fluent builder that queries are made with."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import ExecutionError
from .expr import AggregateRef, ColumnRef, Expr


@dataclass(frozen=True)
class OrderBy:
    expr: Expr
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.expr} {'DESC' if self.descending else 'ASC'}"


class Plan:
    """A node; the methods put another node on top of it."""

    def filter(self, predicate: Expr) -> Plan:
        return Filter(self, predicate)

    def project(self, *columns: str) -> Plan:
        return Project(self, tuple(columns))

    def aggregate(self, keys: list[str], column: str, func: str) -> Plan:
        return Aggregate(self, tuple(keys), func, column)

    def group_filter(self, predicate: Expr) -> Plan:
        return GroupFilter(self, predicate)

    def join(self, right: Plan, left_on: str, right_on: str) -> Plan:
        return Join(self, right, left_on, right_on)

    def sort(self, *order: OrderBy) -> Plan:
        return Sort(self, tuple(order))

    def limit(self, n: int | None, offset: int = 0) -> Plan:
        return Limit(self, n, offset)


@dataclass(frozen=True)
class Scan(Plan):
    table: str


@dataclass(frozen=True)
class Filter(Plan):
    child: Plan
    predicate: Expr


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Aggregate(Plan):
    child: Plan
    keys: tuple[str, ...]
    func: str
    column: str


@dataclass(frozen=True)
class GroupFilter(Plan):
    child: Plan
    predicate: Expr


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan
    left_on: str
    right_on: str


@dataclass(frozen=True)
class Sort(Plan):
    child: Plan
    order: tuple[OrderBy, ...]


@dataclass(frozen=True)
class Limit(Plan):
    child: Plan
    n: int | None
    offset: int = 0


def scan(table: str) -> Scan:
    return Scan(table)


@dataclass
class Builder:
    """Collects the clauses of a query in any order; ``build`` puts them into the fixed order of execution."""

    table: str | None = None
    columns: list[str] = field(default_factory=list)
    predicate: Expr | None = None
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    keys: list[str] | None = None
    aggregation: tuple[str, str] | None = None
    having: Expr | None = None
    order: list[OrderBy] = field(default_factory=list)
    n: int | None = None
    skip: int | None = None

    def from_(self, table: str) -> Builder:
        if self.table is not None:
            raise ExecutionError("FROM clause already specified")
        self.table = table
        return self

    def select(self, *columns: str) -> Builder:
        self.columns += columns
        return self

    def filter(self, predicate: Expr) -> Builder:
        self.predicate = predicate if self.predicate is None else self.predicate.and_(predicate)
        return self

    def join(self, table: str, left_on: str, right_on: str) -> Builder:
        self.joins.append((table, left_on, right_on))
        return self

    def group_by(self, *keys: str) -> Builder:
        if self.keys is not None:
            raise ExecutionError("GROUP BY already specified")
        self.keys = list(keys)
        return self

    def agg(self, func, column: str | None = None) -> Builder:
        """``agg("SUM", "x")`` or ``agg(sum_("x"))``."""
        if self.keys is None:
            raise ExecutionError("AGG cannot be used without GROUP BY")
        if self.aggregation is not None:
            raise ExecutionError("AGG already specified")
        self.aggregation = (func.upper(), column) if column is not None else (func.func, func.column)
        return self

    def group_filter(self, predicate: Expr) -> Builder:
        if self.keys is None:
            raise ExecutionError("GROUP FILTER cannot be used without GROUP BY")
        self.having = predicate if self.having is None else self.having.and_(predicate)
        return self

    def order_by(self, *terms) -> Builder:
        """Terms are names, expressions or OrderBy; they replace earlier ones."""
        self.order = [t if isinstance(t, OrderBy) else OrderBy(ColumnRef(t) if isinstance(t, str) else t) for t in terms]
        return self

    def limit(self, n: int) -> Builder:
        self.n = n
        return self

    def offset(self, n: int) -> Builder:
        self.skip = n
        return self

    def build(self) -> Plan:
        if self.table is None:
            raise ExecutionError("FROM clause is required")
        plan: Plan = Scan(self.table)
        for table, left_on, right_on in self.joins:
            plan = Join(plan, Scan(table), left_on, right_on)
        if self.predicate is not None:
            plan = Filter(plan, self.predicate)
        if self.keys is not None:
            if self.aggregation is None:
                raise ExecutionError("AGG required after GROUP BY")
            plan = Aggregate(plan, tuple(self.keys), *self.aggregation)
        if self.having is not None:
            plan = GroupFilter(plan, self.having)
        if self.columns:
            plan = Project(plan, tuple(self.columns))
        if self.order:
            plan = Sort(plan, tuple(self.order))
        if self.n is not None or self.skip:
            plan = Limit(plan, self.n, self.skip or 0)
        return plan


def aql() -> Builder:
    return Builder()


def agg_ref(func: str, column: str) -> AggregateRef:
    return AggregateRef(func.upper(), column)
