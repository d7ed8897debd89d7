"""Frame: a lazy table with grouping, row order and verbs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.aggregates import Across
from lodestone.functions.expr import Desc, Expr, as_expr
from lodestone.functions.selectors import resolve
from lodestone.functions.windows import WindowCall
from lodestone.plans.order import Key, fresh, hidden, quoted, visible
from lodestone.types import BOOL, Typed, kind_of, need, spark_name


class Frame:
    """Verbs over a Spark DataFrame. Frames are immutable and can be used again.

    filter, select, rename, relocate, arrange, transmute, the slices and the
    joins drop the grouping; mutate keeps it.
    """

    def __init__(self, df: DataFrame, groups: Sequence[str] = (), order: Sequence[Key] = (), arranged: bool = False, meta: dict | None = None):
        self._df, self.groups, self.order = df, tuple(groups), tuple(order)
        self.arranged, self.meta = arranged, meta or {}

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str | Desc] = (), meta: dict | None = None) -> Frame:
        """A frame over df: small ints widen to int64, decimals and floats to double."""
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        if len(kinds) < len(df.columns):
            raise ValueError("duplicate column names")
        made = [
            quoted(f.name) if spark_name(kinds[f.name]) == f.dataType.simpleString() or kinds[f.name] not in ("int64", "double")
            else quoted(f.name).cast(spark_name(kinds[f.name])).alias(f.name, metadata=f.metadata)
            for f in df.schema.fields
        ]
        return cls(df.select(*made), meta=meta).with_order(*order)

    def _with(self, df: DataFrame, **changes: Any) -> Frame:
        kept = {"groups": (), "order": self.order, "arranged": self.arranged, "meta": self.meta}
        return Frame(df, **(kept | changes))

    # -- description ---------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return visible(self._df)

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self._df.schema.fields if f.name in set(self.columns)}

    def scope(self) -> dict[str, Typed]:
        return {name: Typed(quoted(name), kind) for name, kind in self.kinds.items()}

    def __repr__(self) -> str:
        head = f"Frame [{len(self.columns)} columns]" + (f" grouped by {', '.join(self.groups)}" if self.groups else "")
        return "\n".join([head, *(f"  {name}: {kind}" for name, kind in self.kinds.items())])

    def explain(self, mode: str = "formatted") -> str:
        """Groups, columns and Spark's plan, as text."""
        df = self.to_df()
        plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
        return f"{self!r}\n{plan}"

    # -- order and grouping --------------------------------------------------

    def with_order(self, *keys: str | Expr | Desc) -> Frame:
        """Declares the row order by columns, which should be unique together."""
        named = [Key(k.name, not isinstance(k, Desc)) if not isinstance(k, str) else Key(k) for k in keys]
        self._known([k.name for k in named])
        df, order = self._keep_keys(named)
        return self._with(df, groups=self.groups, order=order)

    def _keep_keys(self, keys: Sequence[Key]) -> tuple[DataFrame, list[Key]]:
        """Hidden copies of the keys: later verbs may drop or change the columns."""
        df, order = self._df, []
        for k in keys:
            name = fresh(df, "k")
            df = df.withColumn(name, quoted(k.name))
            order.append(Key(name, k.ascending))
        return df, order

    def ordered(self) -> Frame:
        """This frame with some order: if none is known, that of its partitions."""
        if self.order:
            return self
        name = fresh(self._df, "m")
        df = self._df.withColumn(name, F.monotonically_increasing_id())
        return self._with(df, groups=self.groups, order=[Key(name, natural=True)])

    def _known(self, names: Sequence[str]) -> None:
        for x in names:
            if x not in self.columns:
                raise KeyError(f"column not found: {x}")

    def group_by(self, *names: str | Expr) -> Frame:
        """Sets the grouping, in place of any other."""
        groups = [x.name if isinstance(x, Expr) else x for x in names]
        if not all(isinstance(x, str) for x in groups):
            raise TypeError("group_by takes bare columns")
        return self._with(self._df, groups=groups)

    def ungroup(self) -> Frame:
        return self._with(self._df)

    # -- rows ----------------------------------------------------------------

    def filter(self, *predicates: Expr) -> Frame:
        """Rows for which every predicate is true."""
        df, scope = self._df, self.scope()
        if not predicates:
            return self
        for p in predicates:
            x = as_expr(p).bind(scope)
            need(x, BOOL, "filter")
            df = df.filter(x.col)
        return self._with(df)

    def arrange(self, *keys: str | Expr | Desc) -> Frame:
        """Stable sort: missing values last, or first in descending keys."""
        if not keys:
            return self
        named = [Key(k if isinstance(k, str) else k.name, not isinstance(k, Desc)) for k in keys]
        if not all(isinstance(k.name, str) for k in named):
            raise TypeError("arrange takes columns or desc(column)")
        self._known([k.name for k in named])
        df, order = self._keep_keys(named)
        return self._with(df, order=[*order, *self.order], arranged=True)

    def slice_head(self, n: int = 1) -> Frame:
        from lodestone.operators.slices import slice_head

        return slice_head(self, n)

    def slice_tail(self, n: int = 1) -> Frame:
        from lodestone.operators.slices import slice_tail

        return slice_tail(self, n)

    def slice_min(self, column: str | Expr, n: int = 1, with_ties: bool = False) -> Frame:
        from lodestone.operators.slices import slice_extreme

        return slice_extreme(self, column, n, with_ties, ascending=True)

    def slice_max(self, column: str | Expr, n: int = 1, with_ties: bool = False) -> Frame:
        from lodestone.operators.slices import slice_extreme

        return slice_extreme(self, column, n, with_ties, ascending=False)

    # -- columns -------------------------------------------------------------

    def _resolve(self, items: Sequence[Any]) -> list[str]:
        return resolve(items, self.columns, self.kinds)

    def _project(self, made: Sequence[Any], **changes: Any) -> Frame:
        return self._with(self._df.select(*made, *map(quoted, hidden(self._df))), **changes)

    def select(self, *items: Any, **renamed: str | Expr) -> Frame:
        """Columns by selection, in that order; new=old renames."""
        named = {new: (old.name if isinstance(old, Expr) else old) for new, old in renamed.items()}
        self._known(list(named.values()))
        plain = [x for x in self._resolve(items) if x not in named.values()]
        return self._project([*map(quoted, plain), *(quoted(old).alias(new) for new, old in named.items())])

    def rename(self, **renamed: str | Expr) -> Frame:
        """rename(new=old); places stay."""
        back = {(old.name if isinstance(old, Expr) else old): new for new, old in renamed.items()}
        self._known(list(back))
        names = [back.get(x, x) for x in self.columns]
        if len(set(names)) < len(names):
            raise ValueError("rename: duplicate column names")
        return self._project([quoted(x).alias(back.get(x, x)) for x in self.columns])

    def relocate(self, *items: Any, before: str | None = None, after: str | None = None) -> Frame:
        """Moves columns, to the front if no place is named."""
        if before is not None and after is not None:
            raise ValueError("relocate: give before or after, not both")
        moved = self._resolve(items)
        rest = [x for x in self.columns if x not in moved]
        at = 0
        if before is not None or after is not None:
            self._known([target := before if before is not None else after])
            left = self.columns[: self.columns.index(target) + (after is not None)]
            at = sum(x in rest for x in left)
        return self._project(map(quoted, [*rest[:at], *moved, *rest[at:]]))

    def _expand(self, positional: Sequence[Across], named: dict[str, Any], skip: Sequence[str] = ()) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for a in positional:
            if not isinstance(a, Across):
                raise TypeError("unnamed arguments must be across(...)")
            items = a.cols if isinstance(a.cols, (list, tuple)) else [a.cols]
            out |= a.expand([x for x in self._resolve(items) if x not in skip])
        return out | named

    def mutate(self, *across: Across, **made: Any) -> Frame:
        """Adds or replaces columns and keeps the grouping.

        Window calls come first. A new column is visible to later expressions
        of the call; a replaced one shows them its old value.
        """
        from lodestone.operators.window import add_windows

        made = self._expand(across, made)
        windows = {k: v for k, v in made.items() if isinstance(v, WindowCall)}
        frame = add_windows(self, windows) if windows else self
        plain = {k: v for k, v in made.items() if not isinstance(v, WindowCall)}
        return frame._computed(plain)

    def _computed(self, made: dict[str, Any]) -> Frame:
        scope, out = self.scope(), {x: quoted(x) for x in self.columns}
        for name, e in made.items():
            x = as_expr(e).bind(scope)
            out[name] = x.col
            scope.setdefault(name, x)
        return self._project([v.alias(k) for k, v in out.items()], groups=self.groups)

    def transmute(self, **made: Any) -> Frame:
        """Only the computed columns."""
        if any(isinstance(v, (WindowCall, Across)) for v in made.values()):
            raise TypeError("transmute takes scalar expressions only")
        done = self._computed(made)
        return done._project([quoted(x) for x in made])

    # -- aggregation ---------------------------------------------------------

    def summarise(self, *across: Across, groups: str = "drop_last", empty: str = "drop", **made: Any) -> Frame:
        from lodestone.operators.aggregate import summarise

        return summarise(self, self._expand(across, made, skip=self.groups), groups, empty)

    summarize = summarise

    def count(self, *names: str | Expr, wt: Any = None, sort: bool = False, name: str = "n") -> Frame:
        from lodestone.operators.aggregate import count

        return count(self, names, wt, sort, name)

    def tally(self, wt: Any = None, sort: bool = False, name: str = "n") -> Frame:
        from lodestone.operators.aggregate import tally

        return tally(self, wt, sort, name)

    def distinct(self, *items: Any, keep_all: bool = False) -> Frame:
        from lodestone.operators.aggregate import distinct

        return distinct(self, items, keep_all)

    def reframe(self, fn: Callable, schema: str, partial: Callable | None = None) -> Frame:
        from lodestone.operators.aggregate import reframe

        return reframe(self, fn, schema, partial)

    # -- joins ---------------------------------------------------------------

    def _join(self, other: Frame, how: str, by: Any, suffix: tuple[str, str], many: bool = False) -> Frame:
        from lodestone.operators.join import join

        return join(self, other, how, by, suffix, many)

    def inner_join(self, other: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), many: bool = False) -> Frame:
        """many=True if many rows of both sides share a key: the result is then made evenly on all cores."""
        return self._join(other, "inner", by, suffix, many)

    def left_join(self, other: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y"), many: bool = False) -> Frame:
        """many as in inner_join."""
        return self._join(other, "left", by, suffix, many)

    def right_join(self, other: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y")) -> Frame:
        return self._join(other, "right", by, suffix)

    def full_join(self, other: Frame, by: Any = None, suffix: tuple[str, str] = (".x", ".y")) -> Frame:
        return self._join(other, "full", by, suffix)

    def semi_join(self, other: Frame, by: Any = None) -> Frame:
        return self._join(other, "semi", by, (".x", ".y"))

    def anti_join(self, other: Frame, by: Any = None) -> Frame:
        return self._join(other, "anti", by, (".x", ".y"))

    # -- results -------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The visible columns as a DataFrame, sorted if the frame was arranged."""
        df = self._df
        if self.arranged and self.order:
            df = df.orderBy(*(k.sort() for k in self.order))
        return df.select(*map(quoted, self.columns))

    def collect(self):
        """All rows as a pandas frame."""
        return self.to_df().toPandas()

    def head(self, n: int = 6):
        """The first rows, collected."""
        return self.slice_head(n).collect()

    def pull(self, column: str | int = -1) -> list:
        """One column as a list: by name, 1-based position, or position from the end."""
        names = self.columns
        if isinstance(column, int):
            if not 1 <= abs(column) <= len(names):
                raise IndexError(f"no column at position {column}")
            column = names[column - 1 if column > 0 else column]
        self._known([column])
        return [r[0] for r in self.to_df().select(quoted(column)).collect()]
