"""Rules as they are written in rule-set files, compiled to Spark SQL by the types of their columns.

A rule is an expression over columns: ``+ - * /``, ``== != < <= > >=``, ``in`` and ``not in`` a list, ``and``,
``or``, ``not`` (or ``& | ~``), numbers, texts, True and False.

* A test against a written text never gives null: an absent value is unequal to every text and in no list.
* Everything else follows SQL: null in, null out, which counts as not met. That holds for two text columns, too.
* A text and a number are unequal, whatever they look like; their order, and sums of both, are errors. Two texts add up
  to one text.
* With the columns of a table given, an unknown column is an error. Without them a column outside the known record
  columns has no type, and Spark converts as it does.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from molaris.functions.sql import name, quoted
from molaris.plans.labels import CODE_COLUMNS, NUMERIC_COLUMNS, TIME_COLUMNS

_ARITHMETIC = {ast.Add: "{} + {}", ast.Sub: "{} - {}", ast.Mult: "{} * {}", ast.Div: "try_divide({}, {})"}
_ORDER = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}

NUMBER, TEXT, TIME, FLAG = "number", "text", "time", "flag"
_KINDS = {"string": TEXT, "boolean": FLAG, "date": TIME, "timestamp": TIME, "timestamp_ntz": TIME}
RECORD_KINDS = dict.fromkeys(NUMERIC_COLUMNS, NUMBER) | dict.fromkeys(CODE_COLUMNS, TEXT) | dict.fromkeys(TIME_COLUMNS, TIME)
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class RuleError(ValueError):
    """A rule that cannot be understood."""


def kinds_of(dtypes: Iterable[tuple[str, str]]) -> dict[str, str | None]:
    """What the rules take the columns of a table for, from its ``dtypes``."""
    return {c.lower(): NUMBER if t.startswith(_NUMBERS) else _KINDS.get(t) for c, t in dtypes}


class Part(NamedTuple):
    """A piece of a rule: its SQL, its kind if known, and whether it is a written value."""

    sql: str
    kind: str | None
    written: bool = False


class _Translation:
    def __init__(self, rule: str, kinds: Mapping[str, str | None], closed: bool):
        self.rule, self.kinds, self.closed = rule, kinds, closed

    def fail(self, what: str):
        raise RuleError(f"{what} in rule: {self.rule}")

    def part(self, node: ast.expr) -> Part:
        handler = getattr(self, "on_" + type(node).__name__.lower(), None)
        if handler is None:
            self.fail(f"{type(node).__name__} is not known")
        return handler(node)

    def on_name(self, node: ast.Name) -> Part:
        column = node.id.lower()
        if self.closed and column not in self.kinds:
            self.fail(f"no column {column}")
        return Part(name(column), self.kinds.get(column))

    def on_constant(self, node: ast.Constant) -> Part:
        if isinstance(node.value, bool):
            return Part(str(node.value).lower(), FLAG, True)
        if isinstance(node.value, str):
            return Part(quoted(node.value), TEXT, True)
        if isinstance(node.value, float):
            return Part(f"{node.value!r}D", NUMBER, True)
        if isinstance(node.value, int):
            return Part(str(node.value), NUMBER, True)
        return self.fail(f"{node.value!r} is not a value")

    def on_binop(self, node: ast.BinOp) -> Part:
        a, b = self.part(node.left), self.part(node.right)
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            return Part(f"({a.sql} {'AND' if isinstance(node.op, ast.BitAnd) else 'OR'} {b.sql})", FLAG)
        pattern = _ARITHMETIC.get(type(node.op)) or self.fail(f"{type(node.op).__name__} is not known")
        if TEXT in (a.kind, b.kind):
            if a.kind == b.kind and isinstance(node.op, ast.Add):
                return Part(f"concat({a.sql}, {b.sql})", TEXT)
            self.fail("arithmetic with a text")
        return Part(f"({pattern.format(a.sql, b.sql)})", NUMBER)

    def on_boolop(self, node: ast.BoolOp) -> Part:
        word = " AND " if isinstance(node.op, ast.And) else " OR "
        return Part(f"({word.join(self.part(v).sql for v in node.values)})", FLAG)

    def on_unaryop(self, node: ast.UnaryOp) -> Part:
        inner = self.part(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return Part(f"(NOT {inner.sql})", FLAG)
        return Part(f"(- {inner.sql})", NUMBER, inner.written) if isinstance(node.op, ast.USub) else inner

    def on_compare(self, node: ast.Compare) -> Part:
        sides = [node.left, *node.comparators]
        parts = [self.one(a, op, b) for a, op, b in zip(sides, node.ops, sides[1:])]
        return Part(parts[0] if len(parts) == 1 else f"({' AND '.join(parts)})", FLAG)

    def one(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> str:
        a = self.part(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            return self.member(a, isinstance(op, ast.In), right)
        b = self.part(right)
        apart = {a.kind, b.kind} == {TEXT, NUMBER}
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = isinstance(op, ast.Eq)
            text_written = any(x.written and x.kind == TEXT for x in (a, b))
            if apart and text_written:
                return "false" if same else "true"
            if apart:
                return f"IF({a.sql} IS NULL OR {b.sql} IS NULL, CAST(NULL AS BOOLEAN), {'false' if same else 'true'})"
            if text_written:
                return f"({a.sql} <=> {b.sql})" if same else f"(NOT ({a.sql} <=> {b.sql}))"
            return f"({a.sql} = {b.sql})" if same else f"({a.sql} <> {b.sql})"
        if apart:
            self.fail("order of a text and a number")
        return f"({a.sql} {_ORDER.get(type(op)) or self.fail('a comparison is not known')} {b.sql})"

    def member(self, a: Part, inside: bool, right: ast.expr) -> str:
        if not isinstance(right, (ast.List, ast.Tuple)) or not right.elts:
            self.fail("a list of values is needed after in")
        # a value of another kind is equal to none
        values = [v.sql for v in map(self.part, right.elts) if {a.kind, v.kind} != {TEXT, NUMBER}]
        test = f"coalesce({a.sql} IN ({', '.join(values)}), false)" if values else "false"
        return test if inside else f"(NOT {test})"


def to_sql(rule: str | bool | None, kinds: Mapping[str, str | None] | None = None) -> str | bool | None:
    """The rule as Spark SQL; no rule and plain booleans stay what they are.

    ``kinds`` (``kinds_of``) are the columns there are; without them, the known record columns.
    """
    if rule is None or isinstance(rule, bool):
        return rule
    try:
        tree = ast.parse(" ".join(str(rule).split()), mode="eval")
    except SyntaxError as e:
        raise RuleError(f"{e.msg} in rule: {rule}") from None
    return _Translation(str(rule), RECORD_KINDS if kinds is None else kinds, kinds is not None).part(tree.body).sql
