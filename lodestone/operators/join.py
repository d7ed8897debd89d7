"""The six equi-joins. Missing keys never match; Spark picks the physical join."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.frame import Frame
from lodestone.plans.order import HIDDEN, hidden, quoted
from lodestone.types import DOUBLE, LatticeError, common, spark_name

#: Shares of a key's left rows, and tasks, for each core in joins of many to many.
SHARES_A_CORE, TASKS_A_CORE = 4, 8
#: Cores to plan for at least, as executors may join after the plan is built.
LEAST_CORES = 8


def join_keys(x: Frame, y: Frame, by: Any) -> list[tuple[str, str]]:
    """None: all common names; a name or list of names; a dict of x name to y name; lists may hold dicts."""
    if by is None:
        pairs = [(k, k) for k in x.columns if k in y.columns]
        if not pairs:
            raise ValueError("no common columns to join by")
        warnings.warn(f"joining by {', '.join(k for k, _ in pairs)}", stacklevel=4)
        return pairs
    pairs = []
    for item in [by] if isinstance(by, (str, Mapping)) else by:
        pairs += list(item.items()) if isinstance(item, Mapping) else [(item, item)]
    for left, right in pairs:
        if left not in x.columns:
            raise KeyError(f"column '{left}' not found in x")
        if right not in y.columns:
            raise KeyError(f"column '{right}' not found in y")
    return pairs


def _dealt(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column, str]]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides in even tasks: left rows by key and a share, right rows once for each share.

    The share is a hash of the row, so that a task that runs again makes the
    same rows. Spark sizes tasks by what they read, which says nothing of what
    they make here, so their number is given. Sorted and merged, as a task then
    holds no more than the right rows of a key, and may spill them. Doubles are
    compared as text, since Spark would deal them out again to normalize them.
    """
    cores = max(LEAST_CORES, left.sparkSession.sparkContext.defaultParallelism)
    names = [(f"{HIDDEN}j{i}", f"{HIDDEN}yj{i}") for i in range(len(keys) + 1)]

    def made(col: Column, kind: str) -> Column:
        return F.when(col == 0, F.lit(0.0)).otherwise(col).cast("string") if kind == DOUBLE else col

    plain = [quoted(f.name) for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    shares = SHARES_A_CORE * cores
    lefts = [made(a, kind) for a, _, kind in keys] + [F.pmod(F.xxhash64(*plain), F.lit(shares)).cast("int")]
    rights = [made(b, kind) for _, b, kind in keys] + [F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))]
    left = left.select("*", *(col.alias(n) for col, (n, _) in zip(lefts, names, strict=True)))
    right = right.select("*", *(col.alias(n) for col, (_, n) in zip(rights, names, strict=True)))
    left = left.repartition(TASKS_A_CORE * cores, *(n for n, _ in names))
    right = right.repartition(TASKS_A_CORE * cores, *(n for _, n in names))
    return left, right.hint("merge"), reduce(lambda p, q: p & q, [quoted(a) == quoted(b) for a, b in names])


def join(x: Frame, y: Frame, how: str, by: Any, suffix: tuple[str, str], many: bool = False) -> Frame:
    """many: keys that many rows of both sides have are dealt out to all cores."""
    pairs = join_keys(x, y, by)
    xk, yk = x.kinds, y.kinds
    kinds = []
    for a, b in pairs:
        try:
            kinds.append(common(xk[a], yk[b]))
        except LatticeError:
            raise LatticeError(f"{how}_join key type mismatch: x.{a} ({xk[a]}) vs y.{b} ({yk[b]})") from None
    left = x._df
    temp = {name: f"{HIDDEN}y{i}" for i, name in enumerate(y.columns)}
    right = y._df.select(*(quoted(name).alias(t) for name, t in temp.items()))

    def cast(col, have: str, want: str):
        return col if have == want else col.cast(spark_name(want))

    keys = [(cast(quoted(a), xk[a], k), cast(quoted(temp[b]), yk[b], k), k) for (a, b), k in zip(pairs, kinds, strict=True)]
    on = reduce(lambda p, q: p & q, [a == b for a, b, _ in keys])
    if many:
        left, right, on = _dealt(left, right, keys)
    if how in ("semi", "anti"):
        return x._with(left.join(right, on, f"left_{how}"))
    joined = left.join(right, on, {"full": "full_outer"}.get(how, how))
    key_of = {a: (b, k) for (a, b), k in zip(pairs, kinds, strict=True)}
    rest = [name for name in y.columns if name not in {b for _, b in pairs}]
    clash = set(x.columns) & set(rest)
    out = []
    for name in x.columns:
        made = quoted(name)
        if name in key_of and how in ("right", "full"):
            other, kind = key_of[name]
            theirs = cast(quoted(temp[other]), yk[other], kind)
            made = theirs if how == "right" else F.coalesce(cast(made, xk[name], kind), theirs)
        out.append(made.alias(name + suffix[0] if name in clash else name))
    out += [quoted(temp[name]).alias(name + suffix[1] if name in clash else name) for name in rest]
    names = [name + suffix[0] if name in clash else name for name in x.columns]
    names += [name + suffix[1] if name in clash else name for name in rest]
    if len(set(names)) < len(names):
        raise ValueError("join: duplicate column names; choose other suffixes")
    ordered = how in ("inner", "left")
    df = joined.select(*out, *(map(quoted, hidden(x._df)) if ordered else ()))
    return x._with(df, order=x.order if ordered else (), arranged=x.arranged and ordered)
