"""summarise, count, tally, distinct and reframe."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.aggregates import Aggregate, n, sum_
from lodestone.functions.expr import Desc, Expr
from lodestone.plans.frame import Frame
from lodestone.plans.order import HIDDEN, Key, quoted

#: Rows and batches that a task holds at most while it cuts groups for reframe.
HELD_ROWS, BATCHES = 50_000, 256


def _grouped(frame: Frame, keys: Sequence[str], made: dict[str, Aggregate], empty: str) -> Frame:
    frame._known(keys)
    scope = frame.scope()
    for name, a in made.items():
        if not isinstance(a, Aggregate):
            raise TypeError(f"summarise: {name} must be one aggregate call")
    cols = [a.bind(scope).alias(name) for name, a in made.items()]
    if keys:
        grouped = frame._df.groupBy(*map(quoted, keys))
        df = grouped.agg(*cols) if cols else frame._df.select(*map(quoted, keys)).distinct()
    else:
        seen = f"{HIDDEN}seen"
        df = frame._df.agg(*cols, F.count(F.lit(1)).alias(seen))
        df = (df.filter(quoted(seen) > 0) if empty == "drop" else df).drop(seen)
    return frame._with(df, order=[Key(k) for k in keys], arranged=False)


def summarise(frame: Frame, made: dict[str, Any], groups: str, empty: str) -> Frame:
    """Keys, then aggregates, all doubles; no row for empty ungrouped input unless empty="keep"."""
    if groups not in ("drop_last", "drop", "keep"):
        raise ValueError(f"groups must be drop_last, drop or keep, not {groups}")
    out = _grouped(frame, frame.groups, made, empty)
    left = {"drop_last": frame.groups[:-1], "drop": (), "keep": frame.groups}[groups]
    return out._with(out._df, groups=left)


def count(frame: Frame, names: Sequence[Any], wt: Any, sort: bool, name: str) -> Frame:
    """Rows, or the sum of wt, by the named columns, which replace any grouping."""
    keys = [x.name if isinstance(x, Expr) else x for x in names]
    out = _grouped(frame, keys, {name: n() if wt is None else sum_(wt)}, "drop")
    return out.arrange(Desc(name)) if sort else out


def tally(frame: Frame, wt: Any, sort: bool, name: str) -> Frame:
    """count() by the existing groups."""
    return count(frame, frame.groups, wt, sort, name)


def distinct(frame: Frame, items: Sequence[Any], keep_all: bool) -> Frame:
    """Different values of the columns; with keep_all the first row of each, in row order.

    min_by over the ordering columns combines on the map side, so a hot key
    doesn't gather its rows; only a descending or nullable order needs a window.
    """
    keys = frame._resolve(items) if items else frame.columns
    if not keep_all or not items:
        df = frame._df.select(*map(quoted, keys)).distinct()
        return frame._with(df, order=[Key(k) for k in keys], arranged=False)
    frame = frame.ordered()
    df = frame._df
    if all(k.ascending for k in frame.order):
        order = F.struct(*[f for k in frame.order for f in (quoted(k.name).isNull(), quoted(k.name))])
        first = F.min_by(F.struct(*map(quoted, df.columns)), order).alias("r")
        df = df.groupBy(*[quoted(k).alias(f"{HIDDEN}g{i}") for i, k in enumerate(keys)]).agg(first).select("r.*")
    else:
        w = Window.partitionBy(*map(quoted, keys)).orderBy(*(k.sort() for k in frame.order))
        df = df.withColumn(f"{HIDDEN}rn", F.row_number().over(w)).filter(F.col(f"{HIDDEN}rn") == 1).drop(f"{HIDDEN}rn")
    return frame._with(df)


def _cut(df: DataFrame, keys: list[str], names: list[str], partial: Callable) -> DataFrame:
    """Of each task's rows those that partial keeps, group by group; a task holds no more than HELD_ROWS and a batch."""
    most, batches_most = HELD_ROWS, BATCHES

    def kept(rows):
        import numpy as np

        if not rows.num_rows:
            return rows
        pdf = rows.select(names).to_pandas()
        groups = [g for _, g in pdf.groupby(keys, sort=False, dropna=False)] if keys else [pdf]
        parts = [partial(g).index for g in groups]
        if not all(p.is_unique and p.isin(g.index).all() for p, g in zip(parts, groups, strict=True)):
            raise ValueError("reframe: partial must return some of its rows, with their index")
        return rows.take(np.sort(np.concatenate([p.to_numpy() for p in parts])))

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0
        for batch in batches:
            held.append(kept(pa.Table.from_batches([batch])))
            rows += held[-1].num_rows
            if rows > most or len(held) > batches_most:
                held = [kept(pa.concat_tables(held))]
                rows = held[0].num_rows
                if rows > most // 2:  # many groups: they can't be cut any more here
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from kept(pa.concat_tables(held)).to_batches()

    return df.mapInArrow(run, df.schema)


def reframe(frame: Frame, fn: Callable, schema: str, partial: Callable | None = None) -> Frame:
    """fn(pandas frame of one group, in row order) gives any number of rows.

    fn returns a dict or pandas frame with the columns of schema; keys are
    repeated beside them. Groups with a missing key are left out. A group must
    fit a task, since fn sees it whole, unless partial(pandas frame of some rows
    of one group, in any order) returns those of them that fn may need, with
    their index: tasks then cut their rows with it first, again and again, and
    fn sees what is left of all of them.
    """
    import pandas as pd

    frame = frame.ordered()
    keys, names = list(frame.groups), frame.columns
    kinds = {f.name: f.dataType.simpleString() for f in frame._df.schema.fields}
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema])
    at = f"{HIDDEN}at"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf[at].is_monotonic_increasing:
            pdf = pdf.sort_values(at)
        out = pd.DataFrame(fn(pdf[names].reset_index(drop=True)))
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    df = frame._df
    for k in keys:
        df = df.filter(quoted(k).isNotNull())
    if partial:
        df = _cut(df, keys, names, partial)
    # Spark sorts, as it may spill; Python gets a number in place of the order's columns, which may be long.
    w = Window.partitionBy(*map(quoted, keys)).orderBy(*(k.sort() for k in frame.order))
    df = df.select(*map(quoted, names), F.row_number().over(w).cast("bigint").alias(at))
    df = df.groupBy(*map(quoted, keys)).applyInPandas(run, full)
    return frame._with(df, order=[Key(k) for k in keys], arranged=False)
