"""Expression trees: what a tidy expression means before its context is known.

An Expr knows its kind - column, scalar, aggregate or window - and becomes a
Spark Column only when a verb compiles it: an aggregate is a plain aggregate in
summarize, a window or a broadcast one-row aggregate in mutate and filter.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Expr:
    """A node: kind is "col", "scalar", "agg" or "window"; build(ctx, *args) gives its Column."""

    def __init__(self, kind: str, build: Callable, args: tuple = (), name: str = "expr", column: str | None = None):
        self.kind, self.build, self.args, self.name, self.column = kind, build, tuple(as_expr(a) for a in args), name, column

    def deep(self) -> bool:
        """Does it hold an aggregate or window anywhere?"""
        return self.kind in ("agg", "window") or any(a.deep() for a in self.args)

    def has_window(self) -> bool:
        return self.kind == "window" or any(a.has_window() for a in self.args)

    def columns(self) -> list[str]:
        own = [self.column] if self.column else []
        return own + [x for a in self.args for x in a.columns()]

    def _two(self, other, fn, name):
        return Expr("scalar", lambda _c, a, b: fn(a, b), (self, other), name)

    def __add__(self, o): return self._two(o, operator.add, "add")
    def __radd__(self, o): return as_expr(o)._two(self, operator.add, "add")
    def __sub__(self, o): return self._two(o, operator.sub, "sub")
    def __rsub__(self, o): return as_expr(o)._two(self, operator.sub, "sub")
    def __mul__(self, o): return self._two(o, operator.mul, "mul")
    def __rmul__(self, o): return as_expr(o)._two(self, operator.mul, "mul")
    def __truediv__(self, o): return self._two(o, lambda a, b: F.try_divide(a, b), "div")  # division by zero is missing
    def __rtruediv__(self, o): return as_expr(o) / self
    def __mod__(self, o): return self._two(o, lambda a, b: F.try_mod(a, b), "mod")
    def __rmod__(self, o): return as_expr(o) % self
    def __floordiv__(self, o): return self._two(o, lambda a, b: F.when(b == 0, None).otherwise(F.call_function("div", a.cast("bigint"), F.nullif(b, F.lit(0)).cast("bigint"))), "div")
    def __pow__(self, o): return self._two(o, lambda a, b: F.pow(a, b), "pow")
    def __rpow__(self, o): return as_expr(o) ** self
    def __eq__(self, o): return self._two(o, operator.eq, "eq")  # noqa: D105
    def __ne__(self, o): return self._two(o, operator.ne, "ne")
    def __lt__(self, o): return self._two(o, operator.lt, "lt")
    def __le__(self, o): return self._two(o, operator.le, "le")
    def __gt__(self, o): return self._two(o, operator.gt, "gt")
    def __ge__(self, o): return self._two(o, operator.ge, "ge")
    def __and__(self, o): return self._two(o, operator.and_, "and")
    def __rand__(self, o): return as_expr(o) & self
    def __or__(self, o): return self._two(o, operator.or_, "or")
    def __ror__(self, o): return as_expr(o) | self
    def __invert__(self): return Expr("scalar", lambda _c, a: ~a, (self,), "not")
    def __neg__(self): return Expr("scalar", lambda _c, a: -a, (self,), "neg")
    def __abs__(self): return Expr("scalar", lambda _c, a: F.abs(a), (self,), "abs")
    def __hash__(self): return id(self)

    def __bool__(self):
        raise TypeError("an expression has no truth value; use &, | and ~, or chain() for 3 <= a < 5")


class Vector:
    """Several values: rows of a summarize, or positions of a mutate."""

    def __init__(self, items):
        self.items = list(items)


def quote(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def col(name: str) -> Expr:
    return Expr("col", lambda _c: quote(name), (), name, column=name)


def lit(value: Any) -> Expr:
    return Expr("scalar", lambda _c: F.lit(value), (), "lit")


def as_expr(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Column):
        return Expr("scalar", lambda _c: x, (), "column")
    return lit(x)


class _Columns:
    """c.name or c["a name"] is a column; c["a":"d"] a range of columns."""

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return col(name)

    def __getitem__(self, name):
        if isinstance(name, slice):
            from ..operators.selection import between

            return between(name.start, name.stop)
        return col(name)


c = _Columns()


def scalar(fn: Callable, name: str) -> Callable:
    """A function of Columns as a function of expressions."""

    def make(*args) -> Expr:
        return Expr("scalar", lambda _c, *a: fn(*a), args, name)

    make.__name__ = name
    return make


def agg(fn: Callable, name: str) -> Callable:
    return lambda *args: Expr("agg", lambda _c, *a: fn(*a), args, name)
