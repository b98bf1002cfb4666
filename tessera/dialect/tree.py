"""Statements and expressions as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str | bool | None


@dataclass(frozen=True)
class ColumnRef(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT, -, +, IS NULL, IS NOT NULL
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT, FLOAT, BOOL or VARCHAR
    length: int | None = None
    nullable: bool = True
    primary_key: bool = False


class Statement:
    pass


@dataclass(frozen=True)
class Select(Statement):
    items: tuple[Expr, ...]
    table: str
    join: str | None = None
    on: Expr | None = None
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    order_by: tuple[Expr, ...] = ()
    descending: bool = False
    limit: int | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class CreateTable(Statement):
    table: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropTable(Statement):
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class Transaction(Statement):
    action: str  # BEGIN, COMMIT or ROLLBACK
