"""Window calls for `mutate`. All results are doubles; the order is the frame's row order."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass
class WindowCall:
    kind: str
    column: str | None = None
    offset: int = 1
    default: float | None = None


def _name(x: Any) -> str:
    name = getattr(x, "name", x)
    if not isinstance(name, str):
        raise TypeError("window functions take a bare column")
    return name


def row_number() -> WindowCall:
    return WindowCall("row_number")


def rank(x: Any) -> WindowCall:
    """Rank from the least value, with gaps; missing values come last."""
    return WindowCall("rank", _name(x))


def dense_rank(x: Any) -> WindowCall:
    return WindowCall("dense_rank", _name(x))


def lag(x: Any, n: int = 1, default: float | None = None) -> WindowCall:
    return WindowCall("lag", _name(x), n, default)


def lead(x: Any, n: int = 1, default: float | None = None) -> WindowCall:
    return WindowCall("lead", _name(x), n, default)


def cumsum(x: Any) -> WindowCall:
    """Running sum; missing from the first missing value on."""
    return WindowCall("cumsum", _name(x))


def cummean(x: Any) -> WindowCall:
    return WindowCall("cummean", _name(x))


def cummin(x: Any) -> WindowCall:
    return WindowCall("cummin", _name(x))


def cummax(x: Any) -> WindowCall:
    return WindowCall("cummax", _name(x))
