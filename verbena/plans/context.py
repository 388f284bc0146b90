"""Compiling expressions into Columns, in the context of a verb.

An ungrouped aggregate inside mutate or filter is a one-row aggregate that is
broadcast-joined (its size is one row at any scale), never a window over a single
partition.  A grouped one is an aggregate by group, joined by the keys, so that no
task holds a whole group: broadcast where a count of the groups, which runs while the plan
is built, finds few, and shuffled otherwise.  Nested aggregates and windows are
staged as temporary columns.
"""

from __future__ import annotations

import functools
import operator
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, quote

_ids = count()
#: Aggregates of up to so many groups are broadcast (single values; lists never are).
FEW = 50_000


class OrderRequired(ValueError):
    """The verb depends on row order and the frame has none."""


def temp(kind: str = "t") -> str:
    return f"__verbena_{kind}{next(_ids)}"


def with_groups(df: DataFrame, groups: tuple[str, ...], aggregates: list[Column], source: DataFrame | None = None) -> DataFrame:
    """df with the aggregates of each row's group in source (df itself by default) as more columns; missing keys are a group."""
    source = df if source is None else source
    if not groups:
        return df.crossJoin(F.broadcast(source.agg(*aggregates)))
    keys = [temp("g") for _ in groups]
    row = source.groupBy(*[quote(g).alias(k) for g, k in zip(groups, keys)]).agg(*aggregates)
    if not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in row.schema) and source.select(*[quote(g) for g in groups]).distinct().limit(FEW + 1).count() <= FEW:
        row = F.broadcast(row)
    return df.join(row, functools.reduce(operator.and_, [quote(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys)]), "left").drop(*keys)


class Context:
    def __init__(self, df: DataFrame, groups: tuple[str, ...], order: tuple, mode: str):
        self.df, self.groups, self.order, self.mode = df, groups, order, mode
        self.temps: list[str] = []
        self.pending: list[tuple[str, Column]] = []

    # -- pieces used by expressions
    def kind(self, column: Column):
        """The data type of a compiled column, by analysis only."""
        try:
            return self.df.select(column.alias("x")).schema[0].dataType
        except AnalysisException:  # it holds an aggregate that is staged later
            return None

    def sort(self) -> list[Column]:
        if not self.order:
            raise OrderRequired("this needs a row order: arrange() first, or make the frame with order_by= or assume_order=True")
        return [quote(n).desc_nulls_first() if d else quote(n).asc_nulls_last() for n, d in self.order]

    def order_key(self) -> list[Column]:
        """Fields whose ascending order is the row order; for descending keys the negated number."""
        if not self.order:
            self.sort()
        out = []
        for n, d in self.order:
            if d:
                key = temp()
                self.df = self.df.withColumn(key, F.row_number().over(self.window().orderBy(*self.sort())))
                self.temps.append(key)
                return [F.col(key).alias("__o")]
            out += [quote(n).isNull().alias(f"__n{len(out)}"), quote(n).alias(f"__o{len(out)}")]
        return out

    def window(self):
        return Window.partitionBy(*[quote(g) for g in self.groups])

    def lift(self, column: Column, by_window: bool = False) -> Column:
        if self.mode == "summarize":
            return column
        if self.groups and by_window:
            return column.over(self.window())
        name = temp("a")
        self.pending.append((name, column))
        self.temps.append(name)
        return F.col(name)

    def distinct(self, column: Column) -> Column:
        return self.lift(F.count_distinct(column))

    def total(self) -> Column:
        """The number of all rows, a one-row count; in summarize it is joined before the groups are made."""
        name = temp("n")
        self.df = with_groups(self.df, (), [F.count(F.lit(1)).alias(name)])
        if self.mode == "summarize":
            return F.max(F.col(name))
        self.temps.append(name)
        return F.col(name)

    def over_ordered(self, column: Column) -> Column:
        return column.over(self.window().orderBy(*self.sort()))

    def running(self, column: Column) -> Column:
        return column.over(self.window().orderBy(*self.sort()).rowsBetween(Window.unboundedPreceding, 0))

    def over_by(self, column: Column, partition: list[Column], order: list[Column]) -> Column:
        own = self.sort() if self.order else []
        return column.over(Window.partitionBy(*[quote(g) for g in self.groups], *partition).orderBy(*order, *own))

    # -- compilation
    def flush(self) -> None:
        if self.pending:
            self.df = with_groups(self.df, self.groups, [c.alias(n) for n, c in self.pending])
            self.pending = []

    def stage(self, e: Expr) -> Column:
        name = temp("s")
        mode, self.mode = self.mode, "row"
        column = self.compile(e)
        self.flush()
        self.mode = mode
        self.df = self.df.withColumn(name, column)
        self.temps.append(name)
        return F.col(name)

    def compile(self, e: Expr) -> Column:
        if e.kind in ("agg", "window"):
            args = [self.stage(a) if a.deep() else self.compile(a) for a in e.args]
            if e.kind == "window" and self.mode == "summarize":
                return self.stage(e)
            return e.build(self, *args)
        return e.build(self, *[self.compile(a) for a in e.args])
