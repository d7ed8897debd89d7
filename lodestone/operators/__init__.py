"""Operators behind the verbs of Frame."""

from lodestone.operators.bind import bind_cols, bind_rows

__all__ = ["bind_cols", "bind_rows"]
