"""group_by, ungroup, summarize, count, tally, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import Vector, as_expr, quote
from ..functions.library import is_number
from ..plans.context import Context, temp
from .projection import expand
from .selection import resolve


class Grouping:
    """Verbs over groups."""

    def group_by(self, *selection, **computed):
        """Set the grouping, from a selection and new=expression keys; a new grouping replaces the old one."""
        frame = self.ungroup()
        if computed:
            frame = frame.mutate(**computed)
        names = resolve(frame.schema, selection) + [n for n in computed if n not in resolve(frame.schema, selection)]
        return frame._with(frame.df, groups=tuple(names))

    def ungroup(self):
        return self._with(self.df, groups=())

    def summarize(self, *across_items, **items):
        """One row a group, with one grouping layer less; vector(a, b) gives several rows."""
        items = {f"__across{i}": a for i, a in enumerate(across_items)} | items
        exprs = expand(self, items)
        ctx = Context(self.df, self.groups, self.order, "summarize")
        out, vectors = [], []
        for name, e in exprs.items():
            if isinstance(e, Vector):
                out.append(F.array(*[ctx.compile(as_expr(x)) for x in e.items]).alias(name))
                vectors.append(name)
            else:
                if not e.deep() and e.columns() and not set(e.columns()) <= set(self.groups):
                    raise ValueError(f"summarize: {name} is no aggregate; take one, such as first(x), which needs a row order")
                column = ctx.compile(e)
                out.append((column if e.deep() else F.first(column)).alias(name))
        keys = [quote(g) for g in self.groups]
        df = ctx.df.groupBy(*keys).agg(*out) if keys else ctx.df.agg(*out)
        if vectors:
            zipped, row = temp("z"), temp("z")
            df = df.withColumn(zipped, F.arrays_zip(*[quote(v) for v in vectors])).withColumn(row, F.explode(zipped))
            names = [n for n in df.columns if n not in (zipped, row)]
            df = df.select(*[F.col(row).getField(n).alias(n) if n in vectors else quote(n) for n in names])
        return self._with(df, groups=self.groups[:-1], order=())

    summarise = summarize

    def _count_name(self, keys: list[str]) -> str:
        name = "n"
        while name in keys:
            name += "n"
        return name

    def count(self, *selection, wt=None, sort: bool = False, **computed):
        """Rows, or the sum of wt, of each combination; the result has no groups."""
        frame = self.mutate(**computed) if computed else self
        keys = [*[g for g in self.groups], *[n for n in resolve(frame.schema, selection) if n not in self.groups], *[k for k in computed if k not in self.groups]]
        name = frame._count_name(keys)
        df = frame.df.groupBy(*[quote(k) for k in keys]).agg(self._counted(wt).alias(name))
        return self._with(df, groups=(), order=((name, True),) if sort else ())

    @staticmethod
    def _counted(wt):
        if wt is None:
            return F.count(F.lit(1))
        return F.coalesce(F.sum(quote(wt if isinstance(wt, str) else wt.column)), F.lit(0))

    def tally(self, wt=None, sort: bool = False):
        """Rows of each group; one grouping layer less."""
        df = self.df.groupBy(*[quote(g) for g in self.groups]).agg(self._counted(wt).alias("n"))
        return self._with(df, groups=self.groups[:-1], order=(("n", True),) if sort else ())

    def summary(self, *selection):
        """One row a column: quartiles and mean of numbers, counts of present, missing and distinct values; one pass."""
        names = resolve(self.schema, selection, default_all=True)
        types = {f.name: f.dataType for f in self.schema}
        aggs = []
        for i, n in enumerate(names):
            c = quote(n)
            if is_number(types[n]):
                x = c.cast("double")
                aggs += [F.min(x).alias(f"min{i}"), F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias(f"q{i}"), F.avg(x).alias(f"mean{i}"), F.max(x).alias(f"max{i}")]
            aggs += [F.count(c).alias(f"there{i}"), F.count(F.lit(1)).alias(f"all{i}"), F.count_distinct(c).alias(f"distinct{i}")]
        row = self.df.agg(*aggs)
        none = F.lit(None).cast("double")
        lines = []
        for i, n in enumerate(names):
            number = is_number(types[n])
            q = lambda k: F.element_at(f"q{i}", k) if number else none  # noqa: B023, E731
            lines.append(F.struct(
                F.lit(n).alias("column"), (F.col(f"min{i}") if number else none).alias("min"), q(1).alias("q1"), q(2).alias("median"),
                (F.col(f"mean{i}") if number else none).alias("mean"), q(3).alias("q3"), (F.col(f"max{i}") if number else none).alias("max"),
                F.col(f"there{i}").alias("non_missing_values"), (F.col(f"all{i}") - F.col(f"there{i}")).alias("missing_values"), F.col(f"all{i}").alias("total_values"),
                (F.col(f"distinct{i}") + F.when(F.col(f"all{i}") > F.col(f"there{i}"), 1).otherwise(0)).alias("unique_values"),
            ))
        return self._with(row.select(F.inline(F.array(*lines))), groups=(), order=())

    def describe(self):
        return self._with(self.df.summary(), groups=(), order=())


