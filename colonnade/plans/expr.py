"""Expressions of predicates: columns, literals, aggregate references, comparisons, AND and OR."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    def eq(self, other) -> Expr:
        return Comparison("=", self, wrap(other))

    def gt(self, other) -> Expr:
        return Comparison(">", self, wrap(other))

    def lt(self, other) -> Expr:
        return Comparison("<", self, wrap(other))

    def and_(self, other: Expr) -> Expr:
        return Logical("AND", self, other)

    def or_(self, other: Expr) -> Expr:
        return Logical("OR", self, other)

    __gt__, __lt__, __and__, __or__ = gt, lt, and_, or_


@dataclass(frozen=True)
class ColumnRef(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal(Expr):
    value: str | int | bool

    def __str__(self) -> str:
        if isinstance(self.value, bool):
            return "true" if self.value else "false"
        return f'"{self.value}"' if isinstance(self.value, str) else str(self.value)


@dataclass(frozen=True)
class AggregateRef(Expr):
    func: str
    column: str

    def __str__(self) -> str:
        return f"{self.func}({self.column})"


@dataclass(frozen=True)
class Comparison(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Logical(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


def wrap(value) -> Expr:
    return value if isinstance(value, Expr) else Literal(value)


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


def lit(value) -> Literal:
    return Literal(value)


def columns_of(e: Expr) -> set[str]:
    if isinstance(e, ColumnRef):
        return {e.name}
    if isinstance(e, (Comparison, Logical)):
        return columns_of(e.left) | columns_of(e.right)
    return set()


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, Logical) and e.op == "AND" else [e]
