"""A SELECT tree to one lazy DataFrame. The order of scans, pushdown, join strategy and exchange is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tessera.dialect import tree
from tessera.dialect.printer import expr_sql
from tessera.errors import EngineError
from tessera.functions.expressions import Scope, has_aggregate, lower, truth

#: What the strategy parameter of a join becomes.
HINTS = {"nested_loop": "shuffle_replicate_nl", "broadcast_hash": "broadcast", "shuffle_hash": "shuffle_hash", "sort_merge": "merge"}


def select(stmt: tree.Select, read: Callable[[str], DataFrame], strategy: str | None = None, directions: list[bool] | None = None) -> DataFrame:
    """``directions``: for each ORDER BY key whether it descends, in place of the statement's one flag."""
    if stmt.join == stmt.table:
        raise EngineError(f"{stmt.table} is named twice, and the dialect has no aliases")
    names = [stmt.table] + ([stmt.join] if stmt.join else [])
    frames = {name: read(name) for name in names}
    scope = Scope([(name, frames[name].schema) for name in names])
    df = frames[stmt.table].alias(stmt.table)
    if stmt.join:
        right = frames[stmt.join].alias(stmt.join)
        if strategy:
            if strategy not in HINTS:
                raise EngineError(f"no join strategy {strategy}")
            right = right.hint(HINTS[strategy])
        condition = truth(lower(stmt.on, scope)) if stmt.on is not None else None
        df = df.crossJoin(right) if condition is None else df.join(right, condition, "inner")
    if stmt.where is not None:
        if has_aggregate(stmt.where):
            raise EngineError("an aggregate in WHERE")
        df = df.filter(truth(lower(stmt.where, scope)))

    order = [(e, directions[k] if directions else stmt.descending) for k, e in enumerate(stmt.order_by)]
    sort = lambda column, down: column.desc() if down else column.asc()
    if stmt.group_by or any(map(has_aggregate, stmt.items)) or any(has_aggregate(e) for e, _ in order):
        df, items, keys = _aggregated(df, stmt, scope, [e for e, _ in order])
    else:
        items, keys = _items(stmt.items, scope), [lower(e, scope).column for e, _ in order]
    if stmt.distinct:
        return _distinct(df, stmt, items, order, sort)
    if order:
        df = df.orderBy(*[sort(k, down) for k, (_, down) in zip(keys, order, strict=True)])
    if stmt.limit is not None:
        df = df.limit(stmt.limit)
    return df.select(*[c.alias(name) for name, c in items])


def _items(items: tuple[tree.Expr, ...], scope: Scope) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for item in items:
        if isinstance(item, tree.Star):
            out += [(f.name, scope.attribute(t, f.name)) for t, f in scope.fields(item.table)]
        else:
            out.append((item.name if isinstance(item, tree.ColumnRef) else expr_sql(item), lower(item, scope).column))
    return out


def _aggregated(df: DataFrame, stmt: tree.Select, scope: Scope, order: list[tree.Expr]):
    """Group once, with every aggregate and key under a name of its own; then items and sort keys are built of those."""
    keys = {e: f"_key{k}" for k, e in enumerate(stmt.group_by)}
    calls: dict[tree.Expr, str] = {}

    def collect(e: tree.Expr) -> None:
        if e in keys:
            return
        if isinstance(e, tree.Call):
            calls.setdefault(e, f"_agg{len(calls)}")
        elif isinstance(e, (tree.ColumnRef, tree.Star)):
            matching = [k for k in keys if isinstance(k, tree.ColumnRef) and isinstance(e, tree.ColumnRef) and k.name == e.name and None in (k.table, e.table)]
            if not matching:
                raise EngineError(f"{expr_sql(e)} is neither grouped nor aggregated")
            keys[e] = keys[matching[0]]
        elif isinstance(e, tree.Unary):
            collect(e.operand)
        elif isinstance(e, tree.Binary):
            collect(e.left)
            collect(e.right)
        elif isinstance(e, tree.Between):
            for part in (e.operand, e.low, e.high):
                collect(part)

    if any(map(has_aggregate, stmt.group_by)):
        raise EngineError("an aggregate in GROUP BY")
    for e in (*stmt.items, *order):
        collect(e)
    by = [lower(e, scope).column.alias(keys[e]) for e in stmt.group_by]
    made = [lower(e, scope).column.alias(name) for e, name in calls.items()]
    grouped = df.groupBy(*by)
    df = grouped.agg(*made) if made else df.select(*by).distinct()
    after = Scope([("_group", df.schema)])
    df = df.alias("_group")

    def rebuilt(e: tree.Expr) -> tree.Expr:
        if e in keys or e in calls:
            return tree.ColumnRef(keys.get(e) or calls[e], "_group")
        match e:
            case tree.Unary(op, operand):
                return tree.Unary(op, rebuilt(operand))
            case tree.Binary(op, left, right):
                return tree.Binary(op, rebuilt(left), rebuilt(right))
            case tree.Between(operand, low, high):
                return tree.Between(rebuilt(operand), rebuilt(low), rebuilt(high))
        return e

    items = [(e.name if isinstance(e, tree.ColumnRef) else expr_sql(e), lower(rebuilt(e), after).column) for e in stmt.items]
    return df, items, [lower(rebuilt(e), after).column for e in order]


def _distinct(df: DataFrame, stmt: tree.Select, items: list[tuple[str, Column]], order, sort) -> DataFrame:
    """Distinct rows can only be ordered by what is selected."""
    places = {item: k for k, item in enumerate(stmt.items)}
    named = {name: k for k, (name, _) in enumerate(items)}
    df = df.select(*[c.alias(f"_{k}") for k, (_, c) in enumerate(items)]).distinct()
    keys = []
    for e, down in order:
        at = places.get(e, named.get(e.name) if isinstance(e, tree.ColumnRef) else None)
        if at is None:
            raise EngineError(f"{expr_sql(e)} is not selected, so DISTINCT rows have no order by it")
        keys.append(sort(df[f"_{at}"], down))
    df = df.orderBy(*keys) if keys else df
    df = df.limit(stmt.limit) if stmt.limit is not None else df
    return df.toDF(*[name for name, _ in items])
