"""TidyFrame: a lazy Spark DataFrame with grouping and row order as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expr import quote
from .operators.grouping import Grouping
from .operators.inspect import _SETTINGS, Inspect, report, with_copies
from .operators.joins import Joins
from .operators.nesting import Nesting
from .operators.projection import Projection
from .operators.reshape import Reshape
from .operators.rows import Rows
from .streaming.guard import check

_VERBS = (
    "select", "transmute", "mutate", "rename", "rename_with", "relocate", "clean_names", "filter", "slice", "slice_sample", "slice_max", "slice_min", "slice_head", "slice_tail", "head", "arrange",
    "distinct", "drop_missing", "fill_missing", "group_by", "ungroup", "summarize", "count", "tally", "summary", "left_join", "right_join", "inner_join", "full_join", "semi_join", "anti_join",
    "bind_rows", "bind_cols", "pivot_wider", "pivot_longer", "separate", "unite", "separate_rows", "nest", "unnest_longer", "unnest_wider",
)


class TidyFrame(Projection, Rows, Grouping, Joins, Reshape, Nesting, Inspect):
    """Verbs return new frames; nothing runs until rows are asked for.

    order_by names the columns of the row order (pairs (name, True) descend).  Verbs
    that depend on order raise OrderRequired without one; assume_order=True takes the
    scan order, stamped once as a sort key.
    """

    def __init__(self, df: DataFrame, groups: tuple[str, ...] = (), order: tuple = (), order_by=None, assume_order: bool = False):
        if order_by:
            order = tuple(o if isinstance(o, tuple) else (o, False) for o in ([order_by] if isinstance(order_by, str) else order_by))
        if assume_order and not order:
            df = df.withColumn("__verbena_scan", F.monotonically_increasing_id())
            order = (("__verbena_scan", False),)
        lower: dict[str, str] = {}
        for n in df.columns:
            if n.lower() in lower and df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
                raise ValueError(f"columns {lower[n.lower()]!r} and {n!r} differ by case only; set spark.sql.caseSensitive=true")
            lower[n.lower()] = n
        self.df, self.groups, self.order = df, tuple(groups), tuple(order)

    def _with(self, df: DataFrame, groups=None, order=None, logged: str = "") -> TidyFrame:
        out = TidyFrame.__new__(TidyFrame)
        out.df, out.groups, out.order = df, self.groups if groups is None else tuple(groups), self.order if order is None else tuple(order)
        return out

    # -- state
    def _hidden(self) -> list[str]:
        return [n for n in self.df.columns if n.startswith("__verbena_")]

    @property
    def columns(self) -> list[str]:
        return [n for n in self.df.columns if not n.startswith("__verbena_")]

    @property
    def schema(self) -> T.StructType:
        out = T.StructType([f for f in self.df.schema if not f.name.startswith("__verbena_")])
        out._verbena_frame = self  # for where() on the data of a column
        return out

    def _visible(self) -> DataFrame:
        return self.df.select(*[quote(n) for n in self.columns]) if self._hidden() else self.df

    # -- leaving and entering
    def to_spark(self, sort: bool = True) -> DataFrame:
        """The DataFrame; sorted by the row order unless sort=False."""
        df = self.df
        if sort and self.order:
            df = df.orderBy(*[quote(n).desc_nulls_first() if d else quote(n).asc_nulls_last() for n, d in self.order])
        return df.select(*[quote(n) for n in self.columns]) if self._hidden() else df

    def collect(self) -> list:
        return self.to_spark().collect()

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.collect()]

    def to_pandas(self):
        return self.to_spark().toPandas()

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    def aside(self, fn: Callable, *args, **kwargs) -> TidyFrame:
        """Call fn for its side effect and go on with this frame."""
        fn(self, *args, **kwargs)
        return self

    def __repr__(self) -> str:
        return f"TidyFrame({', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.schema)}; groups={list(self.groups)})"


def _watched(name: str, verb: Callable) -> Callable:
    def run(self, *args, **kwargs):
        check(name, self, args, kwargs)
        out = verb(self, *args, **kwargs)
        if _SETTINGS["code"]:
            out.df.explain("formatted")
        if _SETTINGS["log"]:
            seen = verb(with_copies(self), *args, **kwargs) if name in ("mutate", "fill_missing") else out
            print(report(name, self, seen))
        return out

    run.__name__, run.__doc__ = name, verb.__doc__
    return run


for _name in _VERBS:
    setattr(TidyFrame, _name, _watched(_name, getattr(TidyFrame, _name)))
TidyFrame.summarise = TidyFrame.summarize


def tidy(df, **kwargs) -> TidyFrame:
    """A TidyFrame of a DataFrame."""
    return df if isinstance(df, TidyFrame) else TidyFrame(df, **kwargs)
