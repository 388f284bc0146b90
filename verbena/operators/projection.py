"""select, transmute, mutate, rename, rename_with, relocate, clean_names, pull."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.expr import Expr, Vector, as_expr, quote
from ..functions.library import Across, Weighted, function_name, is_number
from ..plans.context import Context, temp
from .selection import resolve


def expand(tf, items: dict) -> dict[str, Expr]:
    """name -> expression, across() spelled out."""
    out: dict[str, Expr] = {}
    for name, e in items.items():
        if isinstance(e, Across):
            out |= _across(tf, e)
        else:
            out[name] = e if isinstance(e, Vector) else as_expr(e)
    return out


def _across(tf, a: Across) -> dict[str, Expr]:
    columns = a.columns if isinstance(a.columns, (list, tuple)) else [a.columns]
    names = [n for n in resolve(tf.schema, columns) if n not in tf.groups]
    weights = {f.weight for f in a.fns if isinstance(f, Weighted)}
    if weights:
        fields = {f.name: f for f in tf.df.schema}
        names = [n for n in names if n not in weights and is_number(fields[n].dataType)]
    out = {}
    for i, f in enumerate(a.fns, 1):
        for n in names:
            column = Expr("col", lambda _c, n=n: quote(n), (), n, column=n)
            if isinstance(f, Weighted):
                out[f"{n}_{i}"] = f.fn(column, Expr("col", lambda _c, w=f.weight: quote(w), (), f.weight, column=f.weight))
            else:
                out[f"{n}_{i}" if weights else f"{n}_{function_name(f)}"] = as_expr(f(column))
    return out


class Projection:
    """Verbs that change columns and leave rows alone."""

    def select(self, *items, **computed):
        """Keep the selected columns in order; new=old renames and new=expression computes. Grouping columns stay."""
        renames = {new: old for new, old in computed.items() if isinstance(old, str) or (isinstance(old, Expr) and old.kind == "col")}
        exprs = {k: v for k, v in computed.items() if k not in renames}
        frame = self.mutate(**exprs) if exprs else self
        names = resolve(frame.schema, items) if items else []
        plan = [(n, n) for n in self.groups if n not in names and n not in [r if isinstance(r, str) else r.column for r in renames.values()]] + [(n, n) for n in names]
        for new, old in computed.items():
            old = new if new in exprs else old if isinstance(old, str) else old.column
            plan = [p for p in plan if p[1] != new] + [(old, new)]
        keep = {old: new for old, new in plan}
        hidden, order = [], []
        for name, d in frame.order:
            if name in keep:
                order.append((keep[name], d))
            else:
                key = name if name.startswith("__verbena_o") else temp("o")
                hidden.append(quote(name).alias(key))
                order.append((key, d))
        df = frame.df.select(*[quote(o).alias(n) for o, n in plan], *hidden)
        return frame._with(df, groups=tuple(keep.get(g, g) for g in frame.groups), order=tuple(order))

    transmute = select

    def mutate(self, *across_items, **items):
        """Add or replace columns; all expressions see the input columns only. Aggregates spread over the group or frame."""
        items = {f"__across{i}": a for i, a in enumerate(across_items)} | items
        exprs = expand(self, {k: v for k, v in items.items()})
        vectors = {k: v for k, v in exprs.items() if isinstance(v, Vector)}
        frame = self
        order = list(self.order)
        ctx = Context(self.df, self.groups, self.order, "row")
        done = {k: ctx.compile(v) for k, v in exprs.items() if k not in vectors}
        if vectors:
            place = ctx.over_ordered(F.row_number())
            for k, v in vectors.items():
                done[k] = F.get(F.array(*[F.lit(x) for x in v.items]), place - 1)
        ctx.flush()
        df = ctx.df
        for i, (name, d) in enumerate(order):
            if name in done:  # the order lives on under a hidden copy of the old values
                key = temp("o")
                df = df.withColumn(key, quote(name))
                order[i] = (key, d)
        df = df.withColumns(done) if done else df
        return frame._with(df.drop(*ctx.temps), order=tuple(order))

    def rename(self, **names):
        """rename(new=old, ...)."""
        pairs = {(o if isinstance(o, str) else o.column): n for n, o in names.items()}
        return self._renamed(pairs)

    def rename_with(self, fn, *selection):
        """Apply a Python function to the selected names, all by default."""
        return self._renamed({n: fn(n) for n in resolve(self.schema, selection, default_all=True)})

    def _renamed(self, pairs: dict[str, str]):
        missing = [o for o in pairs if o not in self.df.columns]
        if missing:
            raise KeyError(f"no columns {missing}")
        df = self.df.select(*[quote(n).alias(pairs.get(n, n)) for n in self.df.columns])
        return self._with(df, groups=tuple(pairs.get(g, g) for g in self.groups), order=tuple((pairs.get(o, o), d) for o, d in self.order))

    def relocate(self, *selection, before=None, after=None):
        """Move columns to the front, or next to an anchor; the columns of an anchor selection gather there."""
        if before is not None and after is not None:
            raise ValueError("relocate takes before or after, not both")
        names = self.columns
        moved = resolve(self.schema, selection)
        if before is None and after is None:
            out = moved + [n for n in names if n not in moved]
        else:
            anchor = [n for n in resolve(self.schema, [before if before is not None else after]) if n not in moved]
            rest = [n for n in names if n not in moved]
            if not anchor:
                raise KeyError("no anchor column")
            anchor = [n for n in rest if n in anchor]
            at = rest.index(anchor[0])
            head, tail = rest[:at], [n for n in rest[at:] if n not in anchor]
            out = head + (moved + anchor if before is not None else anchor + moved) + tail
        return self._with(self.df.select(*[quote(n) for n in out], *[quote(n) for n in self._hidden()]))

    def clean_names(self, case: str = "snake_case"):
        """Names of letters, digits and underscores: snake_case or camelCase; repeats get _1, _2."""
        if case not in ("snake_case", "camelCase"):
            raise ValueError("case is snake_case or camelCase")
        pairs, seen = {}, {}
        for n in self.columns:
            spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", n))
            words = [w.lower() for w in re.split(r"[^0-9A-Za-z]+", spaced) if w] or ["x"]
            new = "_".join(words) if case == "snake_case" else words[0] + "".join(w.capitalize() for w in words[1:])
            seen[new] = seen.get(new, -1) + 1
            pairs[n] = new if not seen[new] else f"{new}_{seen[new]}"
        return self._renamed(pairs)

    def pull(self, column=-1) -> list:
        """The values of one column, by name or position, as a list, in row order."""
        name = self.columns[column - 1 if column > 0 else column] if isinstance(column, int) else column if isinstance(column, str) else column.column
        return [r[0] for r in self.to_spark().select(quote(name)).collect()]
