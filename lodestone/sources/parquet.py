"""Parquet, the engine's native format, and pandas frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.plans.frame import Frame
from lodestone.plans.order import HIDDEN, Key


def read_parquet(spark: SparkSession, path: str) -> Frame:
    """A lazy frame over Parquet; its row order is file path, then row number.

    The order comes from Spark's file metadata columns, which cost nothing
    unless an operation needs them.
    """
    if not isinstance(path, str):
        raise TypeError("read_parquet: path must be one string")
    df = spark.read.parquet(path)
    frame = Frame.of(df)
    file, row = f"{HIDDEN}f0", f"{HIDDEN}f1"
    keyed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    casts = {f.name: f.dataType for f in frame._df.schema.fields if df.schema[f.name].dataType != f.dataType}
    if casts:
        keyed = keyed.withColumns({k: F.col(f"`{k}`").cast(t) for k, t in casts.items()})
    return Frame(keyed, order=[Key(file, natural=True), Key(row, natural=True)])


def write_parquet(frame: Frame, path: str, batch_size: int | None = None, mode: str = "errorifexists") -> None:
    """Writes Parquet; batch_size is the most rows of a file. The commit makes it atomic."""
    writer = frame.to_df().write.mode(mode)
    if batch_size:
        writer = writer.option("maxRecordsPerFile", int(batch_size))
    writer.parquet(path)


def from_pandas(spark: SparkSession, data: Any) -> Frame:
    """A frame from a pandas frame: NaN in double columns becomes missing, factors their labels."""
    import pandas as pd

    data = data.copy()
    fields, order = [], f"{HIDDEN}i0"
    for name in data.columns:
        x = data[name]
        if isinstance(x.dtype, pd.CategoricalDtype):
            x, kind = x.astype(object), "string"
        elif pd.api.types.is_bool_dtype(x):
            kind = "boolean"
        elif pd.api.types.is_integer_dtype(x):
            kind = "bigint"
        elif pd.api.types.is_float_dtype(x):
            kind = "double"
        elif pd.api.types.is_datetime64_any_dtype(x):
            kind = "timestamp"
        else:
            kinds = {type(v) for v in x if v is not None and v == v}
            known = {bool: "boolean", int: "bigint", float: "double", str: "string"}
            if len(kinds) > 1 and kinds <= {int, float}:
                kinds = {float}
            if len(kinds) > 1 or (kinds and next(iter(kinds)) not in known and next(iter(kinds)).__name__ != "date"):
                raise TypeError(f"unsupported column type: {name}")
            kind = known.get(next(iter(kinds)), "date") if kinds else "string"
        fields.append(f"`{name}` {kind}")
        data[name] = pd.Series([None if v is None or v is pd.NaT or v is pd.NA or v != v else v for v in x], dtype=object, index=x.index)
    rows = [(*r, i) for i, r in enumerate(data.itertuples(index=False, name=None))]
    rows = [tuple(v.item() if hasattr(v, "item") and not isinstance(v, pd.Timestamp) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    df = spark.createDataFrame(rows, ", ".join([*fields, f"{order} bigint"]))
    return Frame(df, order=[Key(order)])
