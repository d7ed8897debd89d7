"""Scalar expressions.

An Expr is unresolved until a verb binds it to the columns of a frame; binding
checks types with the lattice and returns a Spark Column, so every mistake is
an error while the plan is built and all work stays in Spark's generated code.

A Python int is an int64 and a float a double: `c.x / 2` truncates on an int64
column, `c.x / 2.0` does not.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.types import (
    BOOL,
    DOUBLE,
    INT,
    STRING,
    LatticeError,
    Typed,
    common,
    is_numeric,
    need,
    need_numeric,
    spark_name,
)

Scope = Mapping[str, Typed]


class Expr:
    """An unresolved expression; `bind(scope)` gives the column and its type."""

    def __init__(self, bind: Callable[[Scope], Typed], text: str, name: str | None = None):
        self.bind, self.text, self.name = bind, text, name

    def __repr__(self) -> str:
        return self.text

    __hash__ = None  # type: ignore[assignment]

    def __bool__(self) -> bool:
        raise TypeError("use & | ~ instead of and, or, not")

    __add__ = lambda a, b: _arith("+", a, b)
    __radd__ = lambda a, b: _arith("+", b, a)
    __sub__ = lambda a, b: _arith("-", a, b)
    __rsub__ = lambda a, b: _arith("-", b, a)
    __mul__ = lambda a, b: _arith("*", a, b)
    __rmul__ = lambda a, b: _arith("*", b, a)
    __truediv__ = lambda a, b: _arith("/", a, b)
    __rtruediv__ = lambda a, b: _arith("/", b, a)
    __mod__ = lambda a, b: _arith("%", a, b)
    __rmod__ = lambda a, b: _arith("%", b, a)
    __eq__ = lambda a, b: _compare("==", a, b)  # type: ignore[assignment]
    __ne__ = lambda a, b: _compare("!=", a, b)  # type: ignore[assignment]
    __lt__ = lambda a, b: _compare("<", a, b)
    __le__ = lambda a, b: _compare("<=", a, b)
    __gt__ = lambda a, b: _compare(">", a, b)
    __ge__ = lambda a, b: _compare(">=", a, b)
    __and__ = lambda a, b: _logic("&", a, b)
    __rand__ = lambda a, b: _logic("&", b, a)
    __or__ = lambda a, b: _logic("|", a, b)
    __ror__ = lambda a, b: _logic("|", b, a)

    def __invert__(self) -> Expr:
        def bind(scope: Scope) -> Typed:
            x = self.bind(scope)
            need(x, BOOL, "~")
            return Typed(~x.col, BOOL)

        return Expr(bind, f"~{self}")

    def __neg__(self) -> Expr:
        def bind(scope: Scope) -> Typed:
            x = self.bind(scope)
            if x.kind not in (INT, DOUBLE):
                raise LatticeError(f"unary - needs a number, not {x.kind}")
            return Typed(-x.col, x.kind)

        return Expr(bind, f"-{self}")


def col(name: str) -> Expr:
    """The column of that name."""

    def bind(scope: Scope) -> Typed:
        if name not in scope:
            raise KeyError(f"column not found: {name}")
        return scope[name]

    return Expr(bind, name, name)


class _Columns:
    """`c.x` or `c["x"]` is the column x."""

    def __getattr__(self, name: str) -> Expr:
        return col(name)

    __getitem__ = __getattr__


c = _Columns()


class _Literal(Expr):
    def __init__(self, value: Any):
        kinds = {type(None): DOUBLE, bool: BOOL, int: INT, float: DOUBLE, str: STRING}
        if type(value) not in kinds:
            raise LatticeError(f"no literal for {type(value).__name__}")
        kind = kinds[type(value)]
        self.value = value
        super().__init__(lambda _: Typed(F.lit(value).cast(spark_name(kind)), kind), repr(value))


def lit(value: Any) -> Expr:
    """A literal: bool, int (int64), float (double), str, or None (missing)."""
    return _Literal(value)


NA = lit(None)


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def _pair(a: Any, b: Any) -> tuple[Expr, Expr]:
    return as_expr(a), as_expr(b)


def _literal_value(e: Expr) -> Any:
    return e.value if isinstance(e, _Literal) else None


def _divide(x: Typed, y: Typed, kind: str, safe: bool) -> Column:
    a, b = x.to(kind), y.to(kind)
    if kind == INT:
        quotient = F.call_function("div", a, b)
        return quotient if safe else F.when(b != 0, quotient)
    return a / b if safe else F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def _remainder(x: Typed, y: Typed, kind: str, safe: bool) -> Column:
    a, b = x.to(kind), y.to(kind)
    if safe:
        return a % b
    if kind == INT:
        return F.when(b != 0, a % b)
    return F.when(b == 0, a * F.lit(float("nan"))).otherwise(a % b)


def _arith(op: str, a: Any, b: Any) -> Expr:
    a, b = _pair(a, b)
    value = _literal_value(b)
    safe = isinstance(value, (int, float)) and not isinstance(value, bool) and value != 0

    def bind(scope: Scope) -> Typed:
        x, y = a.bind(scope), b.bind(scope)
        if not (is_numeric(x.kind) and is_numeric(y.kind)):
            raise LatticeError(f"{op}: cannot combine {x.kind} and {y.kind}")
        kind = common(common(x.kind, y.kind), INT)
        if op == "/":
            return Typed(_divide(x, y, kind, safe), kind)
        if op == "%":
            return Typed(_remainder(x, y, kind, safe), kind)
        does = {"+": operator.add, "-": operator.sub, "*": operator.mul}[op]
        return Typed(does(x.to(kind), y.to(kind)), kind)

    return Expr(bind, f"({a} {op} {b})")


def _compare(op: str, a: Any, b: Any) -> Expr:
    a, b = _pair(a, b)
    does = {
        "==": operator.eq, "!=": operator.ne, "<": operator.lt,
        "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    }[op]
    missing = any(isinstance(e, _Literal) and e.value is None for e in (a, b))

    def bind(scope: Scope) -> Typed:
        x, y = a.bind(scope), b.bind(scope)
        if missing:
            return Typed(F.lit(None).cast("boolean"), BOOL)
        if x.kind == y.kind:
            return Typed(does(x.col, y.col), BOOL)
        kind = common(x.kind, y.kind, op)
        return Typed(does(x.to(kind), y.to(kind)), BOOL)

    return Expr(bind, f"({a} {op} {b})")


def _logic(op: str, a: Any, b: Any) -> Expr:
    a, b = _pair(a, b)

    def bind(scope: Scope) -> Typed:
        x, y = a.bind(scope), b.bind(scope)
        need(x, BOOL, op)
        need(y, BOOL, op)
        return Typed(x.col & y.col if op == "&" else x.col | y.col, BOOL)

    return Expr(bind, f"({a} {op} {b})")


def is_na(x: Any) -> Expr:
    """Is the value missing? NaN is not missing."""
    x = as_expr(x)
    return Expr(lambda scope: Typed(x.bind(scope).col.isNull(), BOOL), f"is_na({x})")


def nchar(s: Any, chars: bool = False) -> Expr:
    """Length of a string: bytes of UTF-8, or code points with chars."""
    s = as_expr(s)

    def bind(scope: Scope) -> Typed:
        x = s.bind(scope)
        need(x, STRING, "nchar")
        return Typed((F.char_length(x.col) if chars else F.octet_length(x.col)).cast("bigint"), INT)

    return Expr(bind, f"nchar({s})")


def substr(s: Any, start: Any, stop: Any, chars: bool = False) -> Expr:
    """Positions start to stop, 1-based and inclusive, of bytes or with chars of code points.

    A start below 1 counts as 1, a stop past the end as the end; empty if stop
    is before start; missing if any argument is missing.
    """
    s, start, stop = as_expr(s), as_expr(start), as_expr(stop)

    def bind(scope: Scope) -> Typed:
        x, a, b = s.bind(scope), start.bind(scope), stop.bind(scope)
        need(x, STRING, "substr")
        need_numeric(a, "substr")
        need_numeric(b, "substr")
        first = F.greatest(a.to(INT), F.lit(1).cast("bigint"))
        last = F.least(b.to(INT), F.octet_length(x.col).cast("bigint"))
        count = F.greatest(last - first + 1, F.lit(0).cast("bigint")).cast("int")
        at = F.least(first, F.lit(2**31 - 1).cast("bigint")).cast("int")
        cut = x.col if chars else x.col.cast("binary")
        cut = F.substring(cut, at, count)
        cut = cut if chars else cut.cast("string")
        return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), cut), STRING)

    return Expr(bind, f"substr({s}, {start}, {stop})")


def grepl(pattern: str, s: Any) -> Expr:
    """Does the string hold this fixed text?"""
    if not isinstance(pattern, str):
        raise TypeError("grepl: the pattern must be a literal string")
    s = as_expr(s)

    def bind(scope: Scope) -> Typed:
        x = s.bind(scope)
        need(x, STRING, "grepl")
        return Typed(x.col.contains(F.lit(pattern)), BOOL)

    return Expr(bind, f"grepl({pattern!r}, {s})")


class Desc:
    """A descending sort key."""

    def __init__(self, name: str):
        self.name = name


def desc(x: Any) -> Desc:
    """Descending order in `arrange`; missing values come first."""
    name = x.name if isinstance(x, Expr) else x
    if not isinstance(name, str):
        raise TypeError("desc: needs a bare column")
    return Desc(name)
