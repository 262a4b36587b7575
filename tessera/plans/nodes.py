"""Expressions and statements as frozen records; equal trees are equal values."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


class Expr:
    def children(self) -> list["Expr"]:
        out: list[Expr] = []
        for f in fields(self):  # type: ignore[arg-type]
            x = getattr(self, f.name)
            out += [x] if isinstance(x, Expr) else [y for y in x if isinstance(y, Expr)] if isinstance(x, tuple) else []
        return out

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Literal(Expr):
    value: Any
    #: Tells 1 from 1.0 and True, which are equal in Python.
    kind: str
    boolean: bool = False


def literal(value: Any) -> Literal:
    return Literal(value, type(value).__name__)


@dataclass(frozen=True)
class Column(Expr):
    name: str  # as typed

    def __eq__(self, other):
        return isinstance(other, Column) and self.name.lower() == other.name.lower()

    def __hash__(self):
        return hash(self.name.lower())


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - + NOT
    x: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # + - * / % = != < <= > >= AND OR IS ISNOT
    a: Expr
    b: Expr


@dataclass(frozen=True)
class In(Expr):
    x: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    x: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    op: str  # LIKE GLOB
    x: Expr
    pattern: Expr
    escape: Expr | None
    negated: bool


@dataclass(frozen=True)
class Cast(Expr):
    x: Expr
    type: str


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    x: Expr | None  # None: COUNT(*)
    distinct: bool


@dataclass(frozen=True)
class Output:
    x: Expr
    alias: str | None


@dataclass(frozen=True)
class Order:
    x: Expr
    descending: bool
    #: A bare integer: the number of an output column.
    ordinal: int | None = None


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...] | None  # None: *
    distinct: bool
    table: str | None
    where: Expr | None
    group: tuple[Expr, ...]
    having: Expr | None
    order: tuple[Order, ...]
    limit: Expr | None
    offset: Expr | None


DEFAULT = object()  # in an INSERT's values


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # upper case
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    default: Expr | None = None
    checks: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    #: (PRIMARY KEY or UNIQUE, columns) of the table's own constraints.
    keys: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[tuple[str, bool], ...]  # name, descending
    unique: bool


@dataclass(frozen=True)
class Drop:
    kind: str  # TABLE INDEX
    name: str


@dataclass(frozen=True)
class Rename:
    table: str
    to: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class Transaction:
    verb: str  # BEGIN COMMIT ROLLBACK


def has_aggregate(x: Expr) -> bool:
    return any(isinstance(y, Aggregate) for y in x.walk())
