"""Verbs on streams.

The engine's own tables are bounded. The stateless verbs (filter, select,
rename, relocate, mutate and transmute without windows) are plain projections, so
they also run on a streaming DataFrame. bind_rows and all that needs an order don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestone.plans.frame import Frame


def apply_stateless(stream: DataFrame, verbs: Callable[[Frame], Frame]) -> DataFrame:
    """Applies a chain of stateless verbs to a streaming DataFrame."""
    out = verbs(Frame.of(stream))
    if out.arranged or out.order:
        raise ValueError("ordered operations need a bounded table")
    return out.to_df()
