"""Everything a verb's argument can be made of."""

from lodestone.functions.aggregates import across, max_, mean, min_, n, sum_
from lodestone.functions.expr import NA, Expr, c, col, grepl, is_na, lit, nchar, substr
from lodestone.functions.selectors import (
    all_of,
    any_of,
    contains,
    cols_between,
    ends_with,
    everything,
    last_col,
    matches,
    starts_with,
    where,
)
from lodestone.functions.windows import (
    cummax,
    cummean,
    cummin,
    cumsum,
    dense_rank,
    lag,
    lead,
    rank,
    row_number,
)

__all__ = [
    "NA", "Expr", "across", "all_of", "any_of", "c", "col", "cols_between", "contains", "cummax",
    "cummean", "cummin", "cumsum", "dense_rank", "desc", "ends_with", "everything", "grepl",
    "is_na", "lag", "last_col", "lead", "lit", "matches", "max_", "mean", "min_", "n", "nchar",
    "rank", "row_number", "starts_with", "substr", "sum_", "where",
]

from lodestone.functions.expr import desc  # noqa: E402
