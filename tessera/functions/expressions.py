"""Expression trees to Columns: name resolution, types, three-valued logic, truthiness, the five aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.dialect import tree
from tessera.dialect.printer import expr_sql
from tessera.errors import EngineError, NotFound, Status, TypeMismatch

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


@dataclass(frozen=True)
class Typed:
    """A Column with the family of its type: number, string, bool, null, or other (which only passes through)."""

    column: Column
    family: str


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "null" if isinstance(kind, T.NullType) else f"other:{kind.simpleString()}"


class Scope:
    """The columns that a statement may name: (table, field) pairs, each an attribute of the joined frame."""

    def __init__(self, tables: list[tuple[str, T.StructType]]) -> None:
        self.tables = tables

    def fields(self, table: str | None = None) -> list[tuple[str, T.StructField]]:
        if table is not None and table not in {name for name, _ in self.tables}:
            raise NotFound(f"no table {table} in this statement")
        return [(name, f) for name, schema in self.tables for f in schema.fields if table in (None, name)]

    def column(self, ref: tree.ColumnRef) -> Typed:
        found = [(t, f) for t, f in self.fields(ref.table) if f.name == ref.name]
        if not found:
            raise EngineError(f"no column {expr_sql(ref)}")
        if len(found) > 1:
            raise EngineError(f"column {ref.name} is ambiguous")
        table, field = found[0]
        return Typed(self.attribute(table, field.name), family(field.dataType))

    @staticmethod
    def attribute(table: str, name: str) -> Column:
        quoted = ".".join("`" + part.replace("`", "``") + "`" for part in (table, name))
        return F.col(quoted)


def is_aggregate(e: tree.Expr) -> bool:
    return isinstance(e, tree.Call) and e.name.upper() in AGGREGATES


def has_aggregate(e: tree.Expr) -> bool:
    match e:
        case tree.Call(_, args):
            return is_aggregate(e) or any(map(has_aggregate, args))
        case tree.Unary(_, operand):
            return has_aggregate(operand)
        case tree.Binary(_, left, right):
            return has_aggregate(left) or has_aggregate(right)
        case tree.Between(operand, low, high):
            return any(map(has_aggregate, (operand, low, high)))
    return False


def truth(x: Typed) -> Column:
    """A value as a condition: nonzero, nonempty or true."""
    if x.family in ("bool", "null"):
        return x.column.cast("boolean")
    if x.family == "number":
        return x.column != 0
    if x.family == "string":
        return x.column != ""
    raise TypeMismatch("this value is no condition")


_COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_ARITHMETIC = {"+": "__add__", "-": "__sub__", "*": "__mul__", "/": "__truediv__", "%": "__mod__"}


def _same_family(x: Typed, y: Typed, what: str) -> None:
    if "null" not in (x.family, y.family) and x.family != y.family:
        raise TypeMismatch(f"{what} of {x.family} and {y.family}")


def lower(e: tree.Expr, scope: Scope) -> Typed:
    match e:
        case tree.Literal(value):
            kinds = {bool: "bool", int: "number", float: "number", str: "string", type(None): "null"}
            return Typed(F.lit(value), kinds[type(value)])
        case tree.ColumnRef():
            return scope.column(e)
        case tree.Unary("NOT", operand):
            return Typed(~truth(lower(operand, scope)), "bool")
        case tree.Unary("IS NULL" | "IS NOT NULL" as op, operand):
            inner = lower(operand, scope).column
            return Typed(inner.isNull() if op == "IS NULL" else inner.isNotNull(), "bool")
        case tree.Unary(sign, operand):
            x = lower(operand, scope)
            if x.family not in ("number", "null"):
                raise TypeMismatch(f"sign of {x.family}")
            return Typed(-x.column if sign == "-" else x.column, x.family)
        case tree.Binary("AND" | "OR" as op, left, right):
            x, y = truth(lower(left, scope)), truth(lower(right, scope))
            return Typed(x & y if op == "AND" else x | y, "bool")
        case tree.Binary(op, left, right):
            x, y = lower(left, scope), lower(right, scope)
            if op in _COMPARE:
                _same_family(x, y, "comparison")
                return Typed(getattr(x.column, _COMPARE[op])(y.column), "bool")
            if {x.family, y.family} - {"number", "null"}:
                raise TypeMismatch(f"{op} of {x.family} and {y.family}")
            return Typed(getattr(x.column, _ARITHMETIC[op])(y.column), "number")
        case tree.Between(operand, low, high):
            x, a, b = (lower(part, scope) for part in (operand, low, high))
            _same_family(x, a, "comparison")
            _same_family(x, b, "comparison")
            return Typed(x.column.between(a.column, b.column), "bool")
        case tree.Call():
            return _aggregate(e, scope)
        case tree.Star():
            raise EngineError("* stands alone or in COUNT(*)")
    raise EngineError(f"no meaning for {e!r}")


def _aggregate(call: tree.Call, scope: Scope) -> Typed:
    name = call.name.upper()
    if name not in AGGREGATES:
        raise EngineError(f"no function {call.name}", Status.UNIMPLEMENTED)
    if len(call.args) != 1:
        raise EngineError(f"{name} takes one argument")
    if isinstance(call.args[0], tree.Star):
        if name != "COUNT":
            raise EngineError(f"{name} takes a value, not *")
        return Typed(F.count(F.lit(1)), "number")
    if has_aggregate(call.args[0]):
        raise EngineError("an aggregate inside of an aggregate")
    x = lower(call.args[0], scope)
    if name in ("SUM", "AVG") and x.family not in ("number", "null"):
        raise TypeMismatch(f"{name} of {x.family}")
    made = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](x.column)
    return Typed(made, x.family if name in ("MIN", "MAX") else "number")
