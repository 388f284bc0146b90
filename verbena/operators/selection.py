"""The column selection grammar: from what a user writes to an ordered list of names.

Forms: "a" or c.a; a 1-based position; a negative one or -c.a, ~c.a, "-a", "!a"
(complement); between("a", "c"), c["a":"c"], "a:c", "1:3" (a range, also negated);
lists and tuples (a union, in order); starts_with, ends_with, matches, contains,
where, everything, and their complements.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

from ..functions.expr import Expr, col


class Selector:
    """pick(schema) gives the names; minus marks a complement."""

    def __init__(self, pick: Callable[[T.StructType], list[str]], minus: bool = False):
        self.pick, self.minus = pick, minus

    def __neg__(self) -> Selector:
        return Selector(self.pick, not self.minus)

    __invert__ = __neg__


def _names(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda s: [f.name for f in s if test(f.name)])


def starts_with(prefix: str) -> Selector:
    return _names(lambda x: x.startswith(prefix))


def ends_with(suffix: str) -> Selector:
    return _names(lambda x: x.endswith(suffix))


def contains(part: str) -> Selector:
    return _names(lambda x: part in x)


def matches(pattern: str, flags: str = "") -> Selector:
    bits = 0
    for f in flags:
        bits |= {"i": re.I, "m": re.M, "s": re.S, "x": re.X}[f]
    return _names(lambda x: re.search(pattern, x, bits) is not None)


def everything() -> Selector:
    return _names(lambda _x: True)


def where(test: Callable) -> Selector:
    """Columns that pass a predicate: of their type, such as is_number, or of their data, as an aggregate expression
    such as lambda x: mean(x) > 5, which takes one job over all columns, as the names depend on it."""

    def pick(s: T.StructType) -> list[str]:
        found = [test(f.dataType) for f in s]
        if not any(isinstance(x, Expr) for x in found):
            return [f.name for f, yes in zip(s, found) if yes]
        from ..plans.context import Context

        frame = getattr(s, "_verbena_frame", None)
        if frame is None:
            raise ValueError("where on data needs a frame")
        ctx = Context(frame.df, (), frame.order, "summarize")
        row = ctx.df.agg(*[ctx.compile(test(col(n))).cast("boolean").alias(f"c{i}") for i, n in enumerate(s.names)]).first()
        return [n for n, yes in zip(s.names, row) if yes]

    return Selector(pick)


def between(start, stop) -> Selector:
    def pick(s: T.StructType) -> list[str]:
        names = s.names
        a, b = (x - 1 if isinstance(x, int) else names.index(_name(x, s)) for x in (start, stop))
        if min(a, b) < 0 or max(a, b) >= len(names):
            raise IndexError(f"no columns {start}:{stop}")
        return names[a : b + 1] if a <= b else names[b : a + 1][::-1]

    return Selector(pick)


def cols(*what) -> Selector:
    return Selector(lambda s: resolve(s, what))


def not_(*what) -> Selector:
    return -cols(*what)


def _name(x, schema: T.StructType) -> str:
    name = x.column if isinstance(x, Expr) else x
    if name not in schema.names:
        raise KeyError(f"no column {name!r}; there are {schema.names}")
    return name


def selector(x, schema: T.StructType) -> Selector:
    """One item of a selection."""
    names = schema.names
    if isinstance(x, Selector):
        return x
    if isinstance(x, bool):
        raise TypeError("a column can't be selected by a truth value")
    if isinstance(x, int):
        if x == 0 or abs(x) > len(names):
            raise IndexError(f"positions run from 1 to {len(names)}, not {x}")
        return Selector(lambda s: [s.names[abs(x) - 1]], x < 0)
    if isinstance(x, (list, tuple)):
        return Selector(lambda s: resolve(s, x))
    if isinstance(x, Expr):
        if x.kind == "col":
            return Selector(lambda s: [_name(x, s)])
        if x.name in ("neg", "not") and x.args[0].kind == "col":
            return Selector(lambda s: [_name(x.args[0], s)], True)
        raise TypeError("not a selection of columns")
    if x in names:
        return Selector(lambda s: [x])
    text = x.strip()
    if text[:1] in "-!" and text:
        return -selector(text[1:].strip(), schema)
    if text.startswith("(") and text.endswith(")"):
        return Selector(lambda s: resolve(s, [t.strip() for t in text[1:-1].split(",")]))
    if text == ":":
        return everything()
    if ":" in text:
        a, b = (int(t) if t.strip().isdigit() else t.strip() for t in text.split(":"))
        return between(a, b)
    if text.isdigit():
        return selector(int(text), schema)
    return Selector(lambda s: [_name(text, s)])


def resolve(schema: T.StructType, items, default_all: bool = False) -> list[str]:
    """Names in order, each once; if the first item is a complement the rest is taken from all columns."""
    items = list(items)
    if not items:
        return list(schema.names) if default_all else []
    picked = [selector(x, schema) for x in items]
    out: list[str] = list(schema.names) if picked[0].minus else []
    for p in picked:
        own = p.pick(schema)
        if p.minus:
            out = [x for x in out if x not in own]
        else:
            out += [x for x in own if x not in out]
    return out
