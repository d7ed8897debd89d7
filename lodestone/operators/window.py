"""Window calls.

Grouped calls are plain Spark windows. Ungrouped ones would put every row in
one task, so beyond SINGLE_TASK_ROWS rows they run bucket by bucket of the row
order: a local window, totals of each bucket, and the totals of the buckets
before it added on. lag and lead join on the row index; ranks are running
counts over the distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.windows import WindowCall
from lodestone.plans.frame import Frame
from lodestone.plans.order import FILE_BUCKET_ROWS, HIDDEN, Key, quoted
from lodestone.types import DOUBLE, LatticeError, is_numeric

#: Up to so many rows an ungrouped window is one task.
SINGLE_TASK_ROWS = 2_000_000
#: Rows looked at for the bounds of the buckets, and rows a bucket should have.
SAMPLE_ROWS, BUCKET_ROWS, MOST_BUCKETS = 20_000, 500_000, 1024


def _buckets(frame: Frame, rows: int) -> tuple[DataFrame, list[str]]:
    """Adds columns that cut the order in consecutive buckets."""
    df, first = frame._df, frame.order[0]
    name, part = f"{HIDDEN}bk0", f"{HIDDEN}bk1"
    x = quoted(first.name)
    if first.natural and len(frame.order) > 1:  # a file, then a row number in it
        row = quoted(frame.order[1].name)
        return df.withColumns({name: x, part: F.floor(row / FILE_BUCKET_ROWS)}), [name, part]
    if first.natural:  # partition number in the upper bits
        return df.withColumn(name, F.shiftright(x, 33)), [name]
    sample = df.select(x.alias("v")).filter("v is not null").sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=7)
    values = sorted((r[0] for r in sample.collect()), key=lambda v: v.encode() if isinstance(v, str) else v)
    count = min(MOST_BUCKETS, rows // BUCKET_ROWS + 1)
    bounds = list(dict.fromkeys(values[len(values) * i // count] for i in range(1, count))) if values else []
    kind = df.select(x).schema[0].dataType
    edges = F.array(*(F.lit(b).cast(kind) for b in bounds)) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    at = F.when(x.isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(edges, lambda e: e < x)))
    return df.withColumn(name, at if first.ascending else -at), [name]


def _running(frame: Frame, calls: dict[str, WindowCall], groups: Sequence[str], rows: int | None) -> DataFrame:
    """row_number and cum* calls; rows is None for one window per group."""
    order = [k.sort() for k in frame.order]
    df, cut = (frame._df, list(groups)) if rows is None else _buckets(frame, rows)
    w = Window.partitionBy(*map(quoted, cut)).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local, totals = {}, {}
    for name, call in calls.items():
        local[f"{HIDDEN}n_{name}"] = F.row_number().over(w)
        totals[f"{HIDDEN}n_{name}"] = F.count(F.lit(1))
        if call.kind == "row_number":
            continue
        x = quoted(call.column)
        f = {"cummin": F.min, "cummax": F.max}.get(call.kind, F.sum)
        local[f"{HIDDEN}v_{name}"], totals[f"{HIDDEN}v_{name}"] = f(x).over(upto), f(x)
        local[f"{HIDDEN}p_{name}"], totals[f"{HIDDEN}p_{name}"] = F.max(x.isNull()).over(upto), F.max(x.isNull())
    out = df.withColumns(local)
    if rows is not None:
        before = Window.orderBy(*map(quoted, cut)).rowsBetween(Window.unboundedPreceding, -1)
        merge = {"n": F.sum, "p": F.max}
        sums = df.groupBy(*map(quoted, cut)).agg(*(t.alias(k) for k, t in totals.items()))
        prior = {}
        for k in totals:
            kind = k[len(HIDDEN)]
            call = calls[k[len(HIDDEN) + 2 :]]
            f = merge.get(kind) or {"cummin": F.min, "cummax": F.max}.get(call.kind, F.sum)
            prior[f"{k}_before"] = f(quoted(k)).over(before)
        sums = sums.select(*(quoted(c).alias(f"{c}_") for c in cut), *(v.alias(k) for k, v in prior.items()))
        on = [quoted(c).eqNullSafe(quoted(f"{c}_")) for c in cut]
        out = out.join(sums, on, "left").drop(*(f"{c}_" for c in cut), *cut)

    def both(k: str, call: WindowCall) -> Column:
        here = quoted(k)
        if rows is None:
            return here
        prior = quoted(f"{k}_before")
        kind = k[len(HIDDEN)]
        if kind == "p":
            return here | F.coalesce(prior, F.lit(False))
        if kind == "v" and call.kind == "cummin":
            return F.least(here, prior)
        if kind == "v" and call.kind == "cummax":
            return F.greatest(here, prior)
        return F.coalesce(here + prior, here, prior)

    made = {}
    for name, call in calls.items():
        count = both(f"{HIDDEN}n_{name}", call)
        if call.kind == "row_number":
            made[name] = count.cast("double")
            continue
        value = both(f"{HIDDEN}v_{name}", call).cast("double")
        value = value / count if call.kind == "cummean" else value
        made[name] = F.when(~both(f"{HIDDEN}p_{name}", call), value)
    extra = [c for c in out.columns if c not in frame._df.columns]
    return out.withColumns(made).drop(*(c for c in extra if c not in made))


def with_row_index(frame: Frame, name: str) -> DataFrame:
    """Adds a dense 1-based row index, a long, in row order."""
    frame = frame.ordered()
    rows = frame._df.count()
    call = {name: WindowCall("row_number")}
    df = _running(frame, call, (), rows if rows > SINGLE_TASK_ROWS else None)
    return df.withColumn(name, quoted(name).cast("bigint"))


def _shifted(frame: Frame, calls: dict[str, WindowCall]) -> DataFrame:
    """lag and lead over all rows by a join on the row index."""
    at = f"{HIDDEN}at"
    df = with_row_index(frame, at)
    names = frame._df.columns
    for i, (name, call) in enumerate(calls.items()):
        step = call.offset if call.kind == "lag" else -call.offset
        value, there = f"{HIDDEN}w{i}", f"{HIDDEN}t{i}"
        other = df.select((quoted(at) + step).alias(there), quoted(call.column).cast("double").alias(value))
        df = df.join(other, quoted(at) == quoted(there), "left")
        default = F.lit(call.default).cast("double")
        df = df.withColumn(name, F.when(quoted(there).isNull(), default).otherwise(quoted(value))).drop(value, there)
    return df.select(*map(quoted, [*(n for n in names if n not in calls), *calls]))


def _ranked(frame: Frame, df: DataFrame, name: str, call: WindowCall) -> DataFrame:
    """A rank over all rows: running counts over the distinct values, joined back."""
    value, count = f"{HIDDEN}rv", "count"
    values = df.groupBy(quoted(call.column).alias("v")).agg(F.count(F.lit(1)).alias(count))
    ranked = Frame(values, order=[Key("v")])
    rows = values.count()
    running = _running(
        ranked, {"upto": WindowCall("cumsum", count), "dense": WindowCall("row_number")}, (),
        rows if rows > SINGLE_TASK_ROWS else None,
    )
    made = quoted("dense") if call.kind == "dense_rank" else quoted("upto") - quoted(count) + 1
    side = running.select(quoted("v").alias(value), made.cast("double").alias(f"{HIDDEN}r"))
    out = df.join(side, quoted(call.column).eqNullSafe(quoted(value)), "left").drop(value)
    return out.withColumn(name, quoted(f"{HIDDEN}r")).drop(f"{HIDDEN}r")


def add_windows(frame: Frame, calls: dict[str, WindowCall]) -> Frame:
    """Adds the results of the calls, over the frame's groups and in its row order."""
    frame, kinds = frame.ordered(), frame.kinds
    frame._known(frame.groups)
    for name, call in calls.items():
        if call.column is not None:
            frame._known([call.column])
            if not call.kind.endswith("rank") and not is_numeric(kinds[call.column]):
                raise LatticeError(f"{call.kind} needs a numeric column, not {kinds[call.column]}")
    temp = {f"{HIDDEN}out{i}": call for i, call in enumerate(calls.values())}
    bools = {c.column for c in temp.values() if c.column and kinds[c.column] == "bool" and not c.kind.endswith("rank")}
    stand = {b: f"{HIDDEN}as_{b}" for b in bools}
    df = frame._df.withColumns({s: quoted(b).cast(DOUBLE) for b, s in stand.items()}) if stand else frame._df
    temp = {k: WindowCall(c.kind, stand.get(c.column, c.column), c.offset, c.default) for k, c in temp.items()}
    work = frame._with(df, groups=frame.groups)
    rows = None if frame.groups else df.count()
    wide = rows is not None and rows > SINGLE_TASK_ROWS
    running = {k: c for k, c in temp.items() if c.kind == "row_number" or c.kind.startswith("cum")}
    shifts = {k: c for k, c in temp.items() if c.kind in ("lag", "lead")}
    ranks = {k: c for k, c in temp.items() if c.kind.endswith("rank")}
    if running:
        df = _running(work, running, frame.groups, rows if wide else None)
        work = work._with(df, groups=frame.groups)
    if shifts and wide:
        df = _shifted(work, shifts)
    elif shifts:
        w = Window.partitionBy(*map(quoted, frame.groups)).orderBy(*(k.sort() for k in frame.order))
        df = df.withColumns({
            k: (F.lag if c.kind == "lag" else F.lead)(quoted(c.column).cast("double"), c.offset, c.default).over(w)
            for k, c in shifts.items()
        })
    for k, c in ranks.items():
        if wide:
            df = _ranked(frame, df, k, c)
        else:
            w = Window.partitionBy(*map(quoted, frame.groups)).orderBy(quoted(c.column).asc_nulls_last())
            df = df.withColumn(k, (F.rank() if c.kind == "rank" else F.dense_rank()).over(w).cast("double"))
    names = dict(zip(calls, temp, strict=True))
    made = [quoted(names.get(x, x)).alias(x) for x in frame.columns]
    made += [quoted(t).alias(x) for x, t in names.items() if x not in frame.columns]
    df = df.select(*made, *(quoted(h) for h in frame._df.columns if h.startswith(HIDDEN)))
    return frame._with(df, groups=frame.groups)
