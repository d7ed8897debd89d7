"""CSV with the engine's type inference."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.frame import Frame
from lodestone.plans.order import quoted
from lodestone.types import kind_of

# Fixed values of the format: missing, true and false tokens, rows that decide the types.
MISSING = ("", "NA", "na", "Na")
TRUE = ("TRUE", "true", "True")
FALSE = ("FALSE", "false", "False")
INFER_ROWS = 1000

_INT = re.compile(r"[+-]?\d+\Z")


def _is_int(x: str) -> bool:
    return bool(_INT.match(x)) and -(2**63) <= int(x) < 2**63


def _is_double(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return "_" not in x


def _infer(values: list[str | None]) -> str:
    """bool, then int64, then double, else string; string if all are missing."""
    known = [v for v in values if v is not None and v not in MISSING]
    if not known:
        return "string"
    for kind, test in (("boolean", lambda v: v in TRUE or v in FALSE), ("bigint", _is_int), ("double", _is_double)):
        if all(map(test, known)):
            return kind
    return "string"


def _typed(name: str, kind: str) -> Column:
    raw = quoted(name)
    x = F.when(raw.isin(*MISSING), F.lit(None)).otherwise(raw)
    if kind == "string":
        return x.alias(name)
    if kind == "boolean":
        return F.when(x.isin(*TRUE), F.lit(True)).when(x.isin(*FALSE), F.lit(False)).alias(name)
    return x.try_cast(kind).alias(name)


def read_csv(spark: SparkSession, path: str) -> Frame:
    """A header row, quoted fields with doubled quotes and line breaks; types from the first rows.

    Cells that don't fit the inferred type are missing; short rows are filled
    up, long ones cut. Line breaks in fields keep Spark from splitting a file,
    so give large inputs as many files.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"',
        mode="PERMISSIVE", enforceSchema=False, emptyValue="", nullValue=None,
    )
    if not raw.columns:
        raise ValueError(f"empty CSV file: {path}")
    first = raw.take(INFER_ROWS)
    kinds = [_infer([r[i] for r in first]) for i in range(len(raw.columns))]
    return Frame.of(raw.select(*(_typed(n, k) for n, k in zip(raw.columns, kinds, strict=True))))


def _text(value: object) -> str:
    if value is None:
        return "NA"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return "%.17g" % value
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[,"\n\r]', text) else text


def write_csv(frame: Frame, path: str, single: bool = True) -> None:
    """Header, least quoting, NA for missing, TRUE and FALSE, 17 digits.

    single writes one local file by way of the driver, row by row; otherwise
    the executors write a directory of part files.
    """
    df = frame.to_df()
    if single:
        with open(path, "w", encoding="utf-8", newline="") as out:
            out.write(",".join(map(_text, df.columns)) + "\n")
            for row in df.toLocalIterator(prefetchPartitions=True):
                out.write(",".join(map(_text, row)) + "\n")
        return
    made = [
        (F.when(quoted(f.name), "TRUE").when(~quoted(f.name), "FALSE") if kind_of(f.dataType) == "bool" else quoted(f.name).cast("string")).alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*made).write.csv(path, header=True, nullValue="NA", escape='"', emptyValue="")
