"""Aggregates. Every result is a double.

Without na_rm a missing value makes the result missing. With na_rm the
identities of empty input are 0, NaN, Inf and -Inf for sum, mean, min and max.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.expr import Expr, as_expr, col
from lodestone.types import DOUBLE, INT, need_numeric

_EMPTY = {"sum": 0.0, "mean": float("nan"), "min": float("inf"), "max": float("-inf")}


class Aggregate:
    """One aggregate call; arg is None for n()."""

    def __init__(self, kind: str, arg: Expr | None = None, na_rm: bool = False):
        self.kind, self.arg, self.na_rm = kind, arg, na_rm

    def bind(self, scope) -> Column:
        if self.arg is None:
            return F.count(F.lit(1)).cast("double")
        x = self.arg.bind(scope)
        need_numeric(x, self.kind)
        value = x.col if x.kind == INT and self.kind != "mean" else x.to(DOUBLE)
        made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[self.kind](value)
        made = made.cast("double")
        if self.na_rm:
            return F.coalesce(made, F.lit(_EMPTY[self.kind]))
        return F.when(~F.bool_or(value.isNull()), made)


def n() -> Aggregate:
    """Rows of the group."""
    return Aggregate("n")


def sum_(x: Any, na_rm: bool = False) -> Aggregate:
    return Aggregate("sum", as_expr(x), na_rm)


def mean(x: Any, na_rm: bool = False) -> Aggregate:
    return Aggregate("mean", as_expr(x), na_rm)


def min_(x: Any, na_rm: bool = False) -> Aggregate:
    return Aggregate("min", as_expr(x), na_rm)


def max_(x: Any, na_rm: bool = False) -> Aggregate:
    return Aggregate("max", as_expr(x), na_rm)


class Across:
    """The same functions over several columns; see across()."""

    def __init__(self, cols, fns, names, options):
        self.cols, self.fns, self.names, self.options = cols, fns, names, options

    def expand(self, chosen: list[str]) -> dict[str, Any]:
        many = isinstance(self.fns, Mapping)
        fns: Mapping[str, Callable] = self.fns if many else {"": self.fns}
        names = self.names or ("{col}_{fn}" if many else "{col}")
        return {
            names.format(col=x, fn=label): f(col(x), **self.options)
            for label, f in fns.items()
            for x in chosen
        }


def across(cols: Any, fns: Any, names: str | None = None, **options: Any) -> Across:
    """Applies a function, or each of a dict of them, to the selected columns.

    Results are named "{col}" for one function and "{col}_{fn}" for a dict, or
    as names says; they come function by function. options go to each call.
    """
    return Across(cols, fns, names, options)
