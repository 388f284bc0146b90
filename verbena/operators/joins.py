"""The six equi-joins, bind_rows and bind_cols."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from ..functions.expr import Expr, quote
from ..plans.context import Context, temp


class DuplicateColumn(ValueError):
    """Both sides of a join have a column of this name that isn't a key."""


def join_keys(left: list[str], right: list[str], by) -> list[tuple[str, str]]:
    """(left, right) names of by: None (shared names), a name, {left: right}, or a list of those."""
    if by is None:
        pairs = [(n, n) for n in left if n in right]
    else:
        pairs = []
        for b in by if isinstance(by, (list, tuple)) else [by]:
            if isinstance(b, dict):
                pairs += [(str(k), v if isinstance(v, str) else v.column) for k, v in b.items()]
            else:
                name = b.column if isinstance(b, Expr) else b
                pairs.append((name, name))
    if not pairs:
        raise ValueError("no columns to join by")
    for a, b in pairs:
        if a not in left or b not in right:
            raise KeyError(f"no key {a!r} or {b!r}")
    return pairs


class Joins:
    """Two-table verbs. Grouping and order end at a join."""

    def _join(self, other, by, how: str, suffix, na_matches: bool):
        right = getattr(other, "df", other)
        if hasattr(other, "_visible"):
            right = other._visible()
        left = self._visible()
        pairs = join_keys(left.columns, right.columns, by)
        keys = {b: a for a, b in pairs}
        renamed = {n: keys.get(n, n) for n in right.columns}
        if how not in ("left_semi", "left_anti"):
            clash = [n for n in right.columns if n not in keys and n in left.columns]
            if clash and suffix is None:
                raise DuplicateColumn(f"both sides have {clash}; give suffix=")
            if clash:
                left = left.select(*[quote(n).alias(n + suffix[0] if n in clash else n) for n in left.columns])
                renamed |= {n: n + suffix[1] for n in clash}
        names = [a for a, _ in pairs]
        right = right.select(*[quote(n).alias(renamed[n]) for n in right.columns])
        if not na_matches:
            out = left.join(right, names, how)
            order = [n for n in left.columns] + [n for n in right.columns if n not in names]
            if how in ("left_semi", "left_anti"):
                order = left.columns
            return self._with(out.select(*[quote(n) for n in order]), groups=(), order=())
        marks = {n: temp("k") for n in names}
        right = right.select(*[quote(n).alias(marks.get(n, n)) for n in right.columns])
        on = functools.reduce(operator.and_, [left[f"`{n}`"].eqNullSafe(right[marks[n]]) for n in names])
        out = left.join(right, on, how)
        if how in ("left_semi", "left_anti"):
            return self._with(out, groups=(), order=())
        key = {n: F.coalesce(left[f"`{n}`"], right[marks[n]]).alias(n) for n in names}
        out = out.select(*[key.get(n, quote(n)) for n in left.columns], *[quote(n) for n in right.columns if n not in marks.values()])
        return self._with(out, groups=(), order=())

    def left_join(self, other, by=None, suffix=None, na_matches=False):
        return self._join(other, by, "left", suffix, na_matches)

    def right_join(self, other, by=None, suffix=None, na_matches=False):
        return self._join(other, by, "right", suffix, na_matches)

    def inner_join(self, other, by=None, suffix=None, na_matches=False):
        return self._join(other, by, "inner", suffix, na_matches)

    def full_join(self, other, by=None, suffix=None, na_matches=False):
        return self._join(other, by, "full", suffix, na_matches)

    def semi_join(self, other, by=None, na_matches=False):
        return self._join(other, by, "left_semi", None, na_matches)

    def anti_join(self, other, by=None, na_matches=False):
        return self._join(other, by, "left_anti", None, na_matches)

    def bind_rows(self, *others, id: str | None = None):
        """All rows of all frames by column name; missing columns are filled with missing; id= names the source, from 1, last."""
        frames = [f._visible() if hasattr(f, "_visible") else f for f in (self, *others)]
        if id:
            source = temp("i")
            frames = [f.withColumn(source, F.lit(i).cast("bigint")) for i, f in enumerate(frames, 1)]
        out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        if id:
            out = out.select(*[quote(n) for n in out.columns if n != source], F.col(source).alias(id))
        return self._with(out, groups=(), order=())

    def bind_cols(self, *others):
        """Columns side by side by position; repeated names get _1, _2. Lengths must agree."""
        out, names, key = None, [], temp("b")
        for f in (self, *others):
            df = f.df.withColumn(key, Context(f.df, (), f.order, "row").over_ordered(F.row_number()))
            renamed = []
            for n in f.columns:
                new, k = n, 0
                while new in names:
                    k += 1
                    new = f"{n}_{k}"
                names.append(new)
                renamed.append(quote(n).alias(new))
            part = df.select(F.col(key), *renamed, F.lit(True).alias(f"{key}_{len(names)}"))
            out = part if out is None else out.join(part, key, "full")
        flags = [x for x in out.columns if x.startswith(key + "_")]
        whole = functools.reduce(operator.and_, [F.col(x).isNotNull() for x in flags])
        out = out.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("bind_cols: frames of different length")).cast("boolean")))
        hidden = temp("o")
        return self._with(out.select(*[quote(n) for n in names], F.col(key).alias(hidden)), groups=(), order=((hidden, False),))
