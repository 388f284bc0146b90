"""pivot_wider, pivot_longer, separate, unite, separate_rows."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Expr, quote
from ..plans.context import temp
from .selection import resolve

MAX_NAMES = 10_000


def _text(x) -> str:
    return x.column if isinstance(x, Expr) else x


def pattern(sep) -> str:
    """A separator as a regular expression: a compiled one as it is, a string literally."""
    return sep.pattern if isinstance(sep, re.Pattern) else "\\Q" + sep + "\\E"


class Reshape:
    def pivot_wider(self, names_from, values_from, values_fill=None, names: list | None = None):
        """One column for each name, in order of first appearance (of name without an order). Several value
        columns give {name}_{value}. names= skips the job that finds the names."""
        names_from = _text(names_from)
        values = [_text(v) for v in (values_from if isinstance(values_from, (list, tuple)) else [values_from])]
        df, key = self.df, quote(names_from)
        if names is None:
            if self.order:
                ranked = df.select(key.alias("k"), F.struct(*[(-quote(n).cast("double") if d else quote(n)).alias(f"o{i}") for i, (n, d) in enumerate(self.order)]).alias("o"))
                found = [r["k"] for r in ranked.groupBy("k").agg(F.min("o").alias("o")).orderBy("o").limit(MAX_NAMES + 1).collect()]
            else:
                found = [r[0] for r in df.select(key).distinct().orderBy(key).limit(MAX_NAMES + 1).collect()]
            if len(found) > MAX_NAMES:
                raise ValueError(f"more than {MAX_NAMES} names; give names=")
            if None in found:
                raise ValueError(f"{names_from} has missing values, which can't name a column")
            names = found
        ids = [n for n in self.columns if n != names_from and n not in values]
        cells = []
        for v in values:
            for x in names:
                own = key == F.lit(x)
                # two rows for one cell are an error, as an aggregate would hide one of them
                once = F.assert_true(F.count(F.when(own, 1)) <= 1, F.lit(f"pivot_wider: several rows for {names_from} = {x}"))
                value = F.max(F.when(own, quote(v))) if not isinstance(self._type(v), (T.MapType,)) else F.any_value(F.when(own, quote(v)), True)
                if values_fill is not None:
                    value = F.when(F.count(F.when(own, 1)) == 0, F.lit(values_fill)).otherwise(value)
                cells.append(F.when(once.isNull(), value).alias(f"{x}_{v}" if len(values) > 1 else str(x)))
        out = df.groupBy(*[quote(i) for i in ids]).agg(*cells)
        return self._with(out, groups=tuple(g for g in self.groups if g in ids), order=tuple(o for o in self.order if o[0] in ids))

    def _type(self, name: str) -> T.DataType:
        return next(f.dataType for f in self.schema if f.name == name)

    def pivot_longer(self, *selection, names_to: str = "variable", values_to: str = "value"):
        """One row for each selected column; columns without a common type become strings."""
        names = resolve(self.schema, selection, default_all=True)
        ids = [n for n in self.columns if n not in names]
        kinds = {f.name: f.dataType for f in self.schema}
        types = {kinds[n] for n in names}
        mixed = len(types) > 1 and not all(isinstance(t, T.NumericType) for t in types)
        df = self.df.select(*[quote(i) for i in ids], *[(quote(n).cast("string") if mixed else quote(n)).alias(n) for n in names])
        out = df.unpivot([quote(i) for i in ids], [quote(n) for n in names], names_to, values_to)
        return self._with(out, groups=tuple(g for g in self.groups if g in ids), order=())

    def separate(self, column, into: list[str], sep, extra: str = "merge"):
        """Split a string column into several at a literal or a compiled regular expression; short rows are
        filled with missing. extra: merge the surplus into the last, drop it, warn (and drop), or error."""
        name = _text(column)
        if extra not in ("merge", "drop", "warn", "error"):
            raise ValueError("extra is merge, drop, warn or error")
        parts, df = temp("p"), self.df
        df = df.withColumn(parts, F.split(quote(name), pattern(sep), len(into) if extra == "merge" else -1))
        if extra == "error":
            df = df.where(F.when(F.coalesce(F.size(parts), F.lit(0)) > len(into), F.raise_error(F.lit(f"separate: more than {len(into)} parts")).cast("boolean")).otherwise(F.lit(True)))
        if extra == "warn":
            import warnings

            if (most := df.agg(F.max(F.size(parts))).first()[0] or 0) > len(into):
                warnings.warn(f"separate dropped surplus parts, up to {most - len(into)} in a row", stacklevel=2)
        kept = [quote(n) for n in self.df.columns if n != name]
        out = df.select(*kept, *[F.get(F.col(parts), F.lit(i)).alias(n) for i, n in enumerate(into)])
        return self._with(out, groups=tuple(g for g in self.groups if g != name), order=tuple(o for o in self.order if o[0] != name))

    def unite(self, new: str, columns, sep: str = "_", remove: bool = True):
        """Join the present values of several columns into one string, at the end."""
        names = resolve(self.schema, columns if isinstance(columns, (list, tuple)) else [columns])
        joined = F.concat_ws(sep, *[quote(n).cast("string") for n in names]).alias(new)
        keep = [n for n in self.df.columns if n != new and not (remove and n in names)]
        out = self.df.select(*[quote(n) for n in keep], joined)
        return self._with(out, groups=tuple(g for g in self.groups if g in keep), order=tuple(o for o in self.order if o[0] in keep))

    def separate_rows(self, *columns, sep):
        """One row for each part; several columns are split side by side and must have as many parts."""
        names = resolve(self.schema, columns)
        kinds = {f.name: f.dataType for f in self.schema}
        split = {n: F.coalesce(F.split(quote(n), pattern(sep)), F.array(F.lit(None).cast("string"))) if isinstance(kinds[n], T.StringType) else F.array(quote(n)) for n in names}
        sizes = [F.size(split[n]) for n in names]
        same = functools.reduce(operator.and_, [sizes[0] == s for s in sizes[1:]], F.lit(True))
        zipped, place = temp("z"), temp("o")
        df = self.df.withColumn(zipped, F.when(same, F.arrays_zip(*[split[n].alias(f"p{i}") for i, n in enumerate(names)])).otherwise(F.raise_error(F.lit("separate_rows: unequal numbers of parts"))))
        df = df.select("*", F.posexplode(zipped).alias(place, "__row"))
        out = df.select(*[F.col("__row").getField(f"p{names.index(n)}").alias(n) if n in names else quote(n) for n in self.df.columns], place)
        order = (*self.order, (place, False)) if self.order and not any(o in names for o, _ in self.order) else ()
        return self._with(out if order else out.drop(place), order=order)
