"""The engine's types and its coercion lattice bool < int64 < double.

Strings never coerce. Dates, timestamps and every other Spark type pass
through; they compare only with their own kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

BOOL, INT, DOUBLE, STRING = "bool", "int64", "double", "string"
_RANK = {BOOL: 0, INT: 1, DOUBLE: 2}
_SPARK = {BOOL: "boolean", INT: "bigint", DOUBLE: "double", STRING: "string"}


class LatticeError(TypeError):
    """A combination of types that the lattice has no common type for."""


@dataclass(frozen=True)
class Typed:
    """A Spark column with the engine's type of it."""

    col: Column
    kind: str

    def to(self, kind: str) -> Column:
        return self.col if kind == self.kind else self.col.cast(_SPARK[kind])


def kind_of(t: T.DataType) -> str:
    """The engine's type of a Spark type; others keep Spark's name."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(t, T.StringType):
        return STRING
    return t.simpleString()


def spark_name(kind: str) -> str:
    return _SPARK.get(kind, kind)


def is_numeric(kind: str) -> bool:
    return kind in _RANK


def common(a: str, b: str, what: str = "expression") -> str:
    """The least type that holds both."""
    if a == b:
        return a
    if a in _RANK and b in _RANK:
        return max(a, b, key=_RANK.__getitem__)
    raise LatticeError(f"{what}: no common type for {a} and {b}")


def need_numeric(x: Typed, what: str) -> None:
    if x.kind not in _RANK:
        raise LatticeError(f"{what} needs a numeric or bool argument, not {x.kind}")


def need(x: Typed, kind: str, what: str) -> None:
    if x.kind != kind:
        raise LatticeError(f"{what} needs {kind}, not {x.kind}")
