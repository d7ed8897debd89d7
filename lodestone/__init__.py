"""lodestone: a verb-style analytics engine compiled to Spark DataFrame plans."""

from lodestone.functions import *  # noqa: F403
from lodestone.functions import __all__ as _functions
from lodestone.operators import bind_cols, bind_rows
from lodestone.plans.frame import Frame
from lodestone.session import build_session
from lodestone.sources import (
    from_pandas,
    read_blocks,
    read_csv,
    read_geotiff,
    read_parquet,
    read_sqlite,
)

__all__ = [
    "Frame", "bind_cols", "bind_rows", "build_session", "from_pandas", "read_blocks", "read_csv", "read_geotiff",
    "read_parquet", "read_sqlite", *_functions,
]
