"""Row slices. Each compiles to Spark's distributed top-k."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.frame import Frame
from lodestone.plans.order import Key, quoted


def _top(frame: Frame, keys: list[Key], n: int, reverse: bool = False) -> Frame:
    sort = [k.flipped() if reverse else k.sort() for k in keys]
    df = frame._df.orderBy(*sort).limit(max(int(n), 0))
    return frame._with(df, order=keys, arranged=True)


def slice_head(frame: Frame, n: int) -> Frame:
    """The first n rows of the whole frame."""
    frame = frame.ordered()
    return _top(frame, list(frame.order), n)


def slice_tail(frame: Frame, n: int) -> Frame:
    """The last n rows of the whole frame, in order."""
    frame = frame.ordered()
    return _top(frame, list(frame.order), n, reverse=True)


def slice_extreme(frame: Frame, column: Any, n: int, with_ties: bool, ascending: bool) -> Frame:
    """The n rows with the least or greatest values, missing ones last or first; exactly n unless with_ties."""
    name = column if isinstance(column, str) else column.name
    frame._known([name])
    df, key = frame._keep_keys([Key(name, ascending)])
    kept = frame._with(df)
    if not with_ties:
        return _top(kept, [*key, *frame.order], n)
    # The n-th value, found by top-k over the key alone; then all rows up to it.
    value = quoted(key[0].name)
    cut = kept._df.select(value.alias("v")).orderBy(F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_first()).limit(max(int(n), 0))
    last = cut.select(F.row_number().over(Window.orderBy(F.col("v").asc_nulls_last() if ascending else F.col("v").desc_nulls_first())).alias("i"), "v").orderBy(F.desc("i")).limit(1)
    edge = F.broadcast(last.select(F.col("v").alias("__lo_edge")))
    test = F.col("__lo_edge").isNull() | (value <= F.col("__lo_edge")) if ascending else value.isNull() | (value >= F.col("__lo_edge"))
    df = kept._df.crossJoin(edge).filter(test).drop("__lo_edge")
    return kept._with(df, order=[*key, *frame.order], arranged=True)
