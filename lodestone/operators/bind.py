"""bind_rows and bind_cols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.window import with_row_index
from lodestone.plans.frame import Frame
from lodestone.plans.order import HIDDEN, Key, quoted
from lodestone.types import common, spark_name


def bind_rows(*frames: Frame, id: str | None = None) -> Frame:  # noqa: A002
    """Rows of all frames, in order; names in order of appearance, missing ones filled.

    Types meet in the lattice. id adds a first column with the 1-based place of the frame.
    """
    if not frames:
        raise ValueError("bind_rows needs a frame")
    kinds: dict[str, str] = {}
    for f in frames:
        for name, kind in f.kinds.items():
            kinds[name] = common(kinds[name], kind, f"bind_rows column {name}") if name in kinds else kind
    place = f"{HIDDEN}b"
    order, parts = [Key(place)], []
    for i, f in enumerate(frames):
        f, have = f.ordered(), f.kinds
        made = [
            (quoted(n) if have.get(n) == k else quoted(n).cast(spark_name(k)) if n in have else F.lit(None).cast(spark_name(k))).alias(n)
            for n, k in kinds.items()
        ]
        keys = [Key(f"{HIDDEN}b{i}_{j}", k.ascending) for j, k in enumerate(f.order)]
        made += [quoted(k.name).alias(new.name) for k, new in zip(f.order, keys, strict=True)]
        made.append(F.lit(i).alias(place))
        if id is not None:
            made.insert(0, F.lit(i + 1).cast("bigint").alias(id))
        order += keys
        parts.append(f._df.select(*made))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Frame(df, order=order)


def bind_cols(*frames: Frame) -> Frame:
    """Columns side by side, row by row; the frames must have equally many rows.

    Each frame gets a dense row index, found bucket by bucket, and the frames
    are joined on it.
    """
    counts = [f._df.count() for f in frames]
    if len(set(counts)) > 1:
        raise ValueError(f"all inputs must have the same number of rows (got {', '.join(map(str, counts))})")
    names = [n for f in frames for n in f.columns]
    if len(set(names)) < len(names):
        raise ValueError("bind_cols: duplicate column names")
    at = f"{HIDDEN}i0"
    parts: list[DataFrame] = []
    for f in frames:
        parts.append(with_row_index(f, at).select(*map(quoted, f.columns), quoted(at)))
    df = reduce(lambda a, b: a.join(b, at), parts)
    return Frame(df.select(*map(quoted, names), quoted(at)), order=[Key(at)])
