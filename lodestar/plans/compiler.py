"""Syntax trees to DataFrames. Only names, types and the dialect's own rules are settled here; Catalyst plans the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import types
from lodestar.functions.expressions import as_number, int_div, sort_key, timestamp_literal, truthy
from lodestar.operators.relational import AGGREGATES, JOINS
from lodestar.plans import syntax as s
from lodestar.plans.errors import BindError

_COMPARISONS = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
_ARITHMETIC = {"+": "__add__", "-": "__sub__", "*": "__mul__", "/": "__truediv__"}


@dataclass
class Source:
    """A table in FROM: its names, and for each column its type and the name that it has in the joined DataFrame."""

    alias: str
    table: str
    columns: dict[str, tuple[str, str]]

    def answers(self, name: str) -> bool:
        return name in (self.alias, self.table)


@dataclass
class Value:
    column: Column
    type: str
    #: A whole-number literal takes the type of what it meets.
    literal: int | None = None


class Scope:
    """Names to columns; after grouping, keys and aggregates to the columns that hold them."""

    def __init__(self, text: str, sources: list[Source], strict: bool = False) -> None:
        self.text, self.sources, self.strict = text, sources, strict
        self.grouped: dict[s.Node, Value] | None = None

    def fail(self, message: str, node: s.Node):
        raise BindError(message, self.text, node.at)

    def resolve(self, node: s.Name) -> tuple[str, str]:
        """Type and inner name of a column."""
        found = [src.columns[node.column] for src in self.sources if node.column in src.columns and (node.table is None or src.answers(node.table))]
        if node.table is not None and not any(src.answers(node.table) for src in self.sources):
            self.fail(f"unknown table {node.table}", node)
        if not found:
            self.fail(f"unknown column {s.render(node)}", node)
        if len(found) > 1:
            self.fail(f"ambiguous column {s.render(node)}", node)
        return found[0]

    def canonical(self, node: s.Node) -> s.Node:
        """The same expression with every column by its inner name, so that t.a and a are one."""
        match node:
            case s.Name():
                return s.Name(None, self.resolve(node)[1], at=node.at)
            case s.Unary(op, value):
                return s.Unary(op, self.canonical(value), at=node.at)
            case s.Binary(op, a, b):
                return s.Binary(op, self.canonical(a), self.canonical(b), at=node.at)
            case s.Call(f, args):
                return s.Call(f, tuple(self.canonical(a) for a in args), at=node.at)
        return node

    def value(self, node: s.Node) -> Value:
        if self.grouped is not None and not isinstance(node, s.Literal):
            if (got := self.grouped.get(self.canonical(node))) is not None:
                return got
            if isinstance(node, s.Name):
                self.fail(f"column {s.render(node)} must be in GROUP BY or in an aggregate", node)
        match node:
            case s.Literal():
                return self.literal(node)
            case s.Name():
                kind, inner = self.resolve(node)
                return Value(F.col(f"`{inner}`"), kind)
            case s.Unary("is null" | "is not null" as op, inner):
                column = self.value(inner).column
                return Value(column.isNull() if op == "is null" else column.isNotNull(), "PRED")
            case s.Unary("not", inner):
                return Value(~self.condition(inner), "PRED")
            case s.Unary("-", inner):
                got = self.value(inner)
                if got.type not in (*types.NUMBERS, "NULL"):
                    self.fail(f"type mismatch: - on {got.type}", node)
                return Value(-got.column, got.type)
            case s.Binary("and", a, b):
                return Value(self.condition(a) & self.condition(b), "PRED")
            case s.Binary("or", a, b):
                return Value(self.condition(a) | self.condition(b), "PRED")
            case s.Binary(op, a, b):
                return self.compare(node, op, self.value(a), self.value(b)) if op in _COMPARISONS else self.arithmetic(node, op, self.value(a), self.value(b))
            case s.Call(f, _) if f in AGGREGATES:
                self.fail(f"aggregate {f} is not allowed here", node)
            case s.Call(f, _):
                self.fail(f"unknown function {f}", node)
            case s.Star():
                self.fail("* is not allowed here", node)
        raise TypeError(node)

    def literal(self, node: s.Literal) -> Value:
        match node.kind:
            case "int":
                if not -types.BIGINT_RANGE <= node.value < types.BIGINT_RANGE:
                    self.fail("whole number out of range", node)
                kind = types.of_int(node.value)
                return Value(F.lit(node.value).cast(types.SPARK[kind]), kind, node.value)
            case "double":
                return Value(F.lit(float(node.value)), "DOUBLE")
            case "string":
                return Value(F.lit(node.value), "VARCHAR")
            case "bool":
                return Value(F.lit(node.value), "BOOL")
            case "date":
                return Value(F.lit(node.value), "DATE")
            case "timestamp":
                return Value(timestamp_literal(node.value.isoformat(sep=" ")), "TIMESTAMP")
        return Value(F.lit(None), "NULL")

    def condition(self, node: s.Node) -> Column:
        """An expression as a condition: predicates, truth values, and numbers that are not zero."""
        got = self.value(node)
        if got.type in ("PRED", "BOOL"):
            return got.column
        if got.type == "NULL":
            return got.column.cast("boolean")
        if got.type in types.NUMBERS:
            return truthy(got.column)
        self.fail(f"type mismatch: {got.type} is no condition", node)

    def plain(self, value: Value) -> Value:
        return Value(as_number(value.column), "INT") if value.type == "PRED" else value

    def meet(self, node: s.Node, a: Value, b: Value) -> tuple[Value, Value, str]:
        """Both sides with one type, or an error."""
        a, b = self.plain(a), self.plain(b)
        if a.type == b.type:
            return a, b, a.type
        if "NULL" in (a.type, b.type):
            kind = b.type if a.type == "NULL" else a.type
            to = types.SPARK.get(kind)
            return tuple(Value(x.column.cast(to), kind) if x.type == "NULL" and to is not None else x for x in (a, b)) + (kind,)
        if a.type in types.NUMBERS and b.type in types.NUMBERS:
            kind = types.wider(a.type, b.type)
            narrow = a if a.type != kind else b
            if self.strict and not (narrow.literal is not None and kind == "BIGINT"):
                self.fail(f"type mismatch: {a.type} and {b.type}", node)
            return tuple(Value(x.column.cast(types.SPARK[kind]), kind) if x.type != kind else x for x in (a, b)) + (kind,)
        self.fail(f"type mismatch: {a.type} and {b.type}", node)

    def compare(self, node: s.Node, op: str, a: Value, b: Value) -> Value:
        a, b, kind = self.meet(node, a, b)
        if kind == "BOOL" and op not in ("=", "<>"):
            self.fail(f"type mismatch: {op} on BOOL", node)
        return Value(getattr(a.column, _COMPARISONS[op])(b.column), "PRED")

    def arithmetic(self, node: s.Node, op: str, a: Value, b: Value) -> Value:
        a, b, kind = self.meet(node, a, b)
        if kind not in (*types.NUMBERS, "NULL"):
            self.fail(f"type mismatch: {op} on {kind}", node)
        if op == "/" and kind in ("INT", "BIGINT"):
            return Value(int_div(a.column, b.column, kind == "BIGINT"), kind)
        return Value(getattr(a.column, _ARITHMETIC[op])(b.column), kind)


def aggregates(node: s.Node) -> list[s.Call]:
    """The aggregate calls in an expression, outermost only."""
    match node:
        case s.Call(f, args):
            return [node] if f in AGGREGATES else [x for a in args for x in aggregates(a)]
        case s.Unary(_, value):
            return aggregates(value)
        case s.Binary(_, a, b):
            return [*aggregates(a), *aggregates(b)]
    return []


def conjuncts(node: s.Node | None) -> list[s.Node]:
    if isinstance(node, s.Binary) and node.op == "and":
        return [*conjuncts(node.left), *conjuncts(node.right)]
    return [] if node is None else [node]


def bounds(node: s.Node | None) -> list[tuple[s.Name, str, s.Literal]]:
    """The conditions column-operator-literal that a predicate implies, turned so that the column is on the left."""
    turned, out = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "<>": "<>"}, []
    for c in conjuncts(node):
        if isinstance(c, s.Binary) and c.op in turned:
            if isinstance(c.left, s.Name) and isinstance(c.right, s.Literal):
                out.append((c.left, c.op, c.right))
            elif isinstance(c.right, s.Name) and isinstance(c.left, s.Literal):
                out.append((c.right, turned[c.op], c.left))
    return out


#: Reads a table: its name, and the conditions on it, which may be used to read less, never to read other rows.
Reader = Callable[[str, list[tuple[str, str, s.Literal]]], DataFrame | None]


def compile_select(spark: SparkSession, query: s.Select, text: str, read: Reader, strict: bool = False) -> DataFrame:
    scope = Scope(text, [], strict)
    df = _from(spark, query, scope, read)
    if query.where is not None:
        for call in aggregates(query.where):
            scope.fail("aggregates are not allowed in WHERE", call)
        df = df.filter(scope.condition(query.where))
    aliases = {i.alias: i.value for i in query.items if isinstance(i, s.Item) and i.alias}

    def unaliased(node: s.Node) -> s.Node:
        return aliases[node.column] if isinstance(node, s.Name) and node.table is None and node.column in aliases else node

    order = [s.SortItem(_with_aliases(o.value, unaliased), o.descending, o.nulls_first, at=o.at) for o in query.order]
    having = query.having
    calls = [c for n in [*(i.value for i in query.items if isinstance(i, s.Item)), *([having] if having else []), *(o.value for o in order)] for c in aggregates(n)]
    if query.group or calls:
        df = _group(df, query, calls, scope)
    if having is not None:
        df = df.filter(scope.condition(having))
    keys = [sort_key(scope.plain(scope.value(o.value)).column, o.descending, o.nulls_first) for o in order if not isinstance(o.value, s.Literal)]
    if keys:
        df = df.orderBy(*keys)
    columns, names = [], []
    for item in query.items:
        if isinstance(item, s.Star):
            if scope.grouped is not None:
                scope.fail("* is not allowed with GROUP BY", item)
            if not scope.sources:
                scope.fail("* needs FROM", item)
            for source in scope.sources:
                for name, (_, inner) in source.columns.items():
                    columns.append(F.col(f"`{inner}`"))
                    names.append(name)
        else:
            columns.append(scope.plain(scope.value(item.value)).column)
            names.append(item.alias or (item.value.column if isinstance(item.value, s.Name) else s.render(item.value)))
    if query.offset:
        df = df.offset(query.offset)
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).toDF(*names)


def _with_aliases(node: s.Node, unaliased: Callable[[s.Node], s.Node]) -> s.Node:
    match node:
        case s.Name():
            return unaliased(node)
        case s.Unary(op, value):
            return s.Unary(op, _with_aliases(value, unaliased), at=node.at)
        case s.Binary(op, a, b):
            return s.Binary(op, _with_aliases(a, unaliased), _with_aliases(b, unaliased), at=node.at)
    return node


def _from(spark: SparkSession, query: s.Select, scope: Scope, read: Reader) -> DataFrame:
    if query.table is None:
        return spark.range(1).select()
    every = [(None, query.table, None), *((j.kind, j.table, j.on) for j in query.joins)]
    outer = any(kind == "left" for kind, _, _ in every)
    known = bounds(query.where)
    df = None
    for kind, ref, on in every:
        alias = ref.alias or ref.name
        if any(src.alias == alias for src in scope.sources):
            scope.fail(f"table name {alias} is used twice", ref)
        # an unqualified name is used for pruning only where there is one table that it can mean
        mine = [(n.column, op, lit) for n, op, lit in known if (n.table in (alias, ref.name) and not (ref.alias and n.table != alias and len(every) > 1)) or (n.table is None and len(every) == 1)] if not (outer and kind == "left") else []
        table = read(ref.name, mine)
        if table is None:
            scope.fail(f"unknown table {ref.name}", ref)
        k = len(scope.sources)
        columns = {f.name.lower(): (types.of_spark(f.dataType), f"t{k}.{f.name.lower()}") for f in table.schema}
        if len(columns) != len(table.columns):
            scope.fail(f"table {ref.name} has two columns of one name", ref)
        table = table.toDF(*(inner for _, inner in columns.values()))
        source = Source(alias, ref.name, columns)
        scope.sources.append(source)
        if kind is None:
            df = table
        elif kind == "cross":
            df = df.crossJoin(table)
        else:
            for call in aggregates(on):
                scope.fail("aggregates are not allowed in ON", call)
            df = df.join(table, scope.condition(on), JOINS[kind])
            if kind in ("semi", "anti"):
                scope.sources.pop()
    return df


def _group(df: DataFrame, query: s.Select, calls: list[s.Call], scope: Scope) -> DataFrame:
    grouped: dict[s.Node, Value] = {}
    keys = []
    for i, key in enumerate(query.group):
        for call in aggregates(key):
            scope.fail("aggregates are not allowed in GROUP BY", call)
        got = scope.plain(scope.value(key))
        keys.append(got.column.alias(f"k{i}"))
        grouped[scope.canonical(key)] = Value(F.col(f"k{i}"), got.type)
    columns = []
    for call in calls:
        name = scope.canonical(call) if call.args != (s.Star(),) else call
        if name in grouped:
            continue
        inner = f"a{len(columns)}"
        columns.append(_aggregate(call, scope, inner))
        grouped[name] = Value(F.col(inner), columns[-1][1])
    made = [c for c, _ in columns]
    if made:
        df = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    else:
        df = df.select(*keys).distinct()
    scope.grouped = grouped
    return df


def _aggregate(call: s.Call, scope: Scope, name: str) -> tuple[Column, str]:
    if len(call.args) != 1:
        scope.fail(f"{call.function} takes one argument", call)
    if isinstance(call.args[0], s.Star):
        if call.function != "count":
            scope.fail(f"{call.function}(*) is not allowed", call)
        return F.count(F.lit(1)).alias(name), "BIGINT"
    for inner in aggregates(call.args[0]):
        scope.fail("aggregates can't be nested", inner)
    got = scope.plain(scope.value(call.args[0]))
    kind = {"count": "BIGINT", "avg": "DOUBLE", "sum": "DOUBLE" if got.type == "DOUBLE" else "BIGINT"}.get(call.function, got.type)
    if call.function in ("sum", "avg") and got.type not in (*types.NUMBERS, "NULL"):
        scope.fail(f"type mismatch: {call.function} on {got.type}", call)
    return AGGREGATES[call.function](got.column).alias(name), kind
