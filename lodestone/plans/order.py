"""Row order.

A frame remembers by which columns its rows are ordered, some of them hidden
(names that start with HIDDEN). Nothing is sorted until an operation needs the
order; Catalyst prunes hidden columns that no one uses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "__lo_"
#: Rows of a file that one bucket of the natural order holds.
FILE_BUCKET_ROWS = 1 << 18


@dataclass(frozen=True)
class Key:
    name: str
    ascending: bool = True
    natural: bool = False

    def sort(self, reverse: bool = False) -> Column:
        x = quoted(self.name)
        return x.asc_nulls_last() if self.ascending != reverse else x.desc_nulls_first()

    def flipped(self) -> Column:
        x = quoted(self.name)
        return x.desc_nulls_first() if self.ascending else x.asc_nulls_last()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    return [x for x in df.columns if not x.startswith(HIDDEN)]


def hidden(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x.startswith(HIDDEN)]


def fresh(df: DataFrame, stem: str) -> str:
    """A hidden name that df doesn't have."""
    i = 0
    while f"{HIDDEN}{stem}{i}" in df.columns:
        i += 1
    return f"{HIDDEN}{stem}{i}"
