"""filter, slices, head, arrange, distinct, drop_missing, fill_missing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import Expr, as_expr, quote
from ..plans.context import Context, temp, with_groups
from .selection import resolve

N = "n"  # slice(N) is the last row
#: Numbers made from one row at a time.
_SPAN = 65_536


class Rows:
    """Verbs that keep, drop, order or fill rows."""

    def filter(self, *conditions):
        """Rows for which every condition is true; missing is not true. Aggregates see all rows of the group."""
        exprs = [as_expr(x) for x in conditions]
        if not any(e.deep() for e in exprs):
            ctx = Context(self.df, self.groups, self.order, "row")
            return self._with(self.df.where(functools.reduce(operator.and_, [ctx.compile(e) for e in exprs])), logged="filter")
        ctx = Context(self.df, self.groups, self.order, "row")
        test = temp("f")
        whole = functools.reduce(operator.and_, [ctx.compile(e) for e in exprs])
        ctx.flush()
        df = ctx.df.withColumn(test, whole).where(F.col(test)).drop(test, *ctx.temps)
        return self._with(df, logged="filter")

    def _numbered(self, reverse: bool = False):
        """(frame with a row number per group, its name)."""
        ctx = Context(self.df, self.groups, self.order, "row")
        name = temp("r")
        sort = ctx.sort()
        if reverse:
            sort = [quote(n).asc_nulls_last() if d else quote(n).desc_nulls_first() for n, d in self.order]
        return self.df.withColumn(name, F.row_number().over(ctx.window().orderBy(*sort))), name

    def _sizes(self, df):
        """The frame with its group size as a column."""
        name = temp("n")
        return with_groups(df, self.groups, [F.count(F.lit(1)).alias(name)], self.df), name

    def _checked(self, df, most: int):
        """df, with an error when its rows are asked for and the ungrouped frame has fewer than most rows."""
        ok = temp("k")
        enough = F.when(F.count(F.lit(1)) >= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"slice: position {most} is beyond the last row")).cast("boolean"))
        return df.crossJoin(F.broadcast(self.df.agg(enough.alias(ok)))).where(F.col(ok)).drop(ok)

    def slice(self, *positions):
        """Rows by 1-based position, per group: ints, ranges and "n" (the last); all positive, in the order given
        and with repeats, or all negative, to drop. Without groups, a position beyond the last row is an error when
        the rows are asked for; a group that has fewer rows gives those it has."""
        flat: list = []
        for p in positions:
            flat += list(p) if isinstance(p, (range, list, tuple)) else [p]
        if any(p == 0 for p in flat):
            raise ValueError("positions start at 1")
        minus = [p for p in flat if (isinstance(p, int) and p < 0) or p == "-n"]
        if minus and len(minus) != len(flat):
            raise ValueError("positions are all positive or all negative")
        if not flat:
            return self._with(self.df.limit(0))
        ints = [p for p in flat if isinstance(p, int)]
        if not self.groups and not minus and len(ints) == len(flat) and flat == list(range(flat[0], flat[-1] + 1)):
            sort = Context(self.df, (), self.order, "row").sort()
            return self._with(self._checked(self.df.orderBy(*sort).offset(flat[0] - 1).limit(len(flat)), flat[-1]))
        df, r = self._numbered()
        if not self.groups and ints:
            df = self._checked(df, max(abs(p) for p in ints))
        size = None
        if len(ints) != len(flat):
            df, size = self._sizes(df)
        if minus:
            gone = F.col(r).isin([-p for p in ints]) if ints else F.lit(False)
            if size:
                gone = gone | (F.col(r) == F.col(size))
            return self._with(df.where(~gone).drop(r, *([size] if size else [])))
        at, rank = F.array(*[F.lit(p) if isinstance(p, int) else F.col(size) for p in flat]), temp("p")
        if len(set(flat)) == len(flat) and len(ints) == len(flat) and flat == sorted(flat):
            return self._with(df.where(F.col(r).isin(flat)).drop(r))
        # in the order given, with repeats: each row once for each place it takes
        places = F.filter(F.transform(at, lambda x, i: F.when(x == F.col(r), i)), lambda x: x.isNotNull())
        df = df.withColumn(rank, F.explode(places)).drop(r, *([size] if size else []))
        hidden = temp("o")
        return self._with(df.withColumnRenamed(rank, hidden), order=((hidden, False),))

    def _placed(self, seed: int):
        """(frame whose rows have a random place from 1 to n in their group, its name, the group sizes (g0, ..., size)).

        A row's random key is a hash of its values and its number among equal rows, so it is the same each time the
        rows are read. The keys' high part is a cell; counts of the cells give the places before each, and rows
        are numbered inside a cell, so that no task holds a whole group.
        """
        one, two, copies, part, key, cell, before, place = (temp(k) for k in ("h", "h", "c", "j", "u", "b", "n", "p"))
        values = [F.to_json(F.struct(quote(f.name))) if "map<" in f.dataType.simpleString() else quote(f.name) for f in self.df.schema]
        hashed = self.df.withColumns({one: F.xxhash64(F.lit(seed), *values), two: F.xxhash64(F.lit(seed), F.lit("2"), *values)})
        groups = [quote(g).alias(f"g{i}") for i, g in enumerate(self.groups)]

        def keyed(names):
            # shuffled before any row is kept: a table of mostly different rows would only fill the reading tasks
            rows = hashed.repartition(one, two).groupBy(*[quote(n) for n in names], one, two).agg(F.count(F.lit(1)).alias(copies))
            rows = rows.withColumn(part, F.explode(F.sequence(F.lit(0), F.expr(f"({copies} - 1) div {_SPAN}"))))
            rows = rows.withColumn(part, F.explode(F.sequence(F.col(part) * _SPAN + 1, F.least(copies, (F.col(part) + 1) * _SPAN))))
            return rows.withColumn(key, F.xxhash64(one, two, part)).withColumn(cell, F.struct(*groups, F.shiftright(key, 54).alias("cell")))

        counts = keyed(self.groups).groupBy(cell).agg(F.count(F.lit(1)).alias(copies))
        own = Window.partitionBy(*[F.col(cell).getField(f"g{i}") for i in range(len(groups))])
        other = temp("b")
        places = counts.select(F.col(cell).alias(other), F.coalesce(F.sum(copies).over(own.orderBy(F.col(cell).getField("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
        df = keyed(self.df.columns).withColumn(place, F.row_number().over(Window.partitionBy(cell).orderBy(key, one, two)))
        df = df.join(places, F.col(cell) == F.col(other)).withColumn(place, F.col(place) + F.col(before))
        sizes = counts.groupBy(*[F.col(cell).getField(f"g{i}").alias(f"g{i}") for i in range(len(groups))]).agg(F.sum(copies).alias("size"))
        return df.select(*[quote(n) for n in self.df.columns], place), place, sizes

    def slice_sample(self, n: int | None = None, prop: float | None = None, replace: bool = False, seed: int = 42):
        """n rows, or a floored share, at random per group."""
        if (n is None) == (prop is None):
            raise ValueError("slice_sample takes n or prop")
        if n is not None and not replace and not self.groups:
            return self._with(self.df.orderBy(F.rand(seed)).limit(n))
        df, place, sizes = self._placed(seed)
        on = [quote(g).alias(f"g{i}") for i, g in enumerate(self.groups)]
        if not replace:
            if n is not None:
                return self._with(df.where(F.col(place) <= n).drop(place))
            df, size = self._sizes(df)
            return self._with(df.where(F.col(place) <= F.floor(F.col(size) * prop)).drop(place, size))
        # the draws of a group are made in spans that any task may take, and each picks a place
        span, draw, wanted = temp("j"), temp("b"), temp("k")
        draws = sizes.withColumn(wanted, F.lit(n).cast("bigint") if n is not None else F.floor(F.col("size") * prop)).where(F.col(wanted) > 0)
        draws = draws.withColumn(span, F.explode(F.sequence(F.lit(0), F.expr(f"({wanted} - 1) div {_SPAN}")))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        draws = draws.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.least(F.lit(_SPAN).cast("bigint"), F.col(wanted) - F.col(span) * _SPAN))))
        draws = draws.withColumn("__at", F.floor(F.rand(seed) * F.col("size")).cast("bigint") + 1)
        draws = draws.select(F.struct(*[F.col(f"g{i}") for i in range(len(on))], F.col("__at").alias("at")).alias(draw))
        at = F.struct(*on, F.col(place).cast("bigint").alias("at"))
        return self._with(df.join(draws, at == F.col(draw)).select(*[quote(c) for c in self.df.columns]))

    def _extreme(self, column, n, prop, with_ties, missing_rm, largest: bool):
        if prop is not None and not 0 <= prop <= 1:
            raise ValueError("prop lies between 0 and 1")
        name = column if isinstance(column, str) else column.column
        x = quote(name)
        df = self.df.where(x.isNotNull()) if missing_rm else self.df
        own = [quote(o).desc_nulls_first() if d else quote(o).asc_nulls_last() for o, d in self.order]
        order = [x.desc_nulls_first() if largest else x.asc_nulls_last(), *own]
        groups = [quote(g) for g in self.groups]
        if not groups and prop is None and not with_ties:
            return self._with(df.orderBy(*order).limit(n or 1), order=((name, largest), *self.order))
        w = Window.partitionBy(*groups)
        r, best, ties, size = temp("r"), temp("b"), temp("m"), temp("n")
        if groups:
            value, same = temp("v"), temp("v")
            by_value = df.groupBy(*groups, *([] if name in self.groups else [x.alias(value)])).agg(F.count(F.lit(1)).alias(same))
            value = x if name in self.groups else F.col(value)
            most = (F.max_by if largest else F.min_by)(F.when(value.isNotNull(), F.col(same)), value)
            df = with_groups(df, self.groups, [most.alias(ties), F.sum(same).alias(size)], by_value)
        else:
            one = df.agg((F.max if largest else F.min)(x).alias(best), F.count(F.lit(1)).alias(size))
            ties_row = df.crossJoin(F.broadcast(one)).where(x == F.col(best)).agg(F.count(F.lit(1)).alias(ties))
            df = df.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(ties_row))
        k = F.lit(n or 1) if prop is None else F.floor(F.col(size) * prop)
        keep = F.greatest(k, F.col(ties)) if with_ties else k
        if not groups:
            # the k best, or all ties, without a window over everything
            count = df.select(keep.alias("k")).limit(1).collect()
            limit = int(count[0][0] or 0) if count else 0
            return self._with(df.orderBy(*order).limit(limit).drop(best, ties, size), order=((name, largest), *self.order))
        df = df.withColumn(r, F.row_number().over(w.orderBy(*order))).where(F.col(r) <= keep)
        return self._with(df.drop(r, best, ties, size), order=((name, largest), *self.order))

    def slice_max(self, column, n: int | None = None, prop: float | None = None, with_ties: bool = True, missing_rm: bool = True):
        """The n largest rows; with ties, all rows equal to the largest are kept even beyond n."""
        return self._extreme(column, n, prop, with_ties, missing_rm, True)

    def slice_min(self, column, n: int | None = None, prop: float | None = None, with_ties: bool = True, missing_rm: bool = True):
        return self._extreme(column, n, prop, with_ties, missing_rm, False)

    def _ends(self, n, prop, reverse: bool):
        if prop is not None and not 0 <= prop <= 1:
            raise ValueError("prop lies between 0 and 1")
        if not self.groups and prop is None and not reverse:
            return self._with(self.df.orderBy(*Context(self.df, (), self.order, "row").sort()).limit(1 if n is None else n))
        df, r = self._numbered(reverse)
        if prop is None:
            return self._with(df.where(F.col(r) <= (1 if n is None else n)).drop(r))
        df, size = self._sizes(df)
        return self._with(df.where(F.col(r) <= F.floor(F.col(size) * prop)).drop(r, size))

    def slice_head(self, n: int | None = None, prop: float | None = None):
        return self._ends(n, prop, False)

    def slice_tail(self, n: int | None = None, prop: float | None = None):
        return self._ends(n, prop, True)

    def head(self, n: int = 6):
        return self._ends(n, None, False)

    def arrange(self, *keys):
        """Set the row order; desc("x") or -c.x descends. Missing is last ascending, first descending.
        The sort itself is done when rows leave (to_spark, collect, pull)."""
        order = []
        for k in keys:
            if isinstance(k, tuple) and k[0] == "desc":
                order.append((k[1], True))
            elif isinstance(k, Expr) and k.name == "neg":
                order.append((k.args[0].column, True))
            else:
                order.append((k if isinstance(k, str) else k.column, False))
        for name, _ in order:
            if name not in self.df.columns:
                raise KeyError(f"no column {name!r}")
        return self._with(self.df, order=tuple(order))

    def distinct(self, *selection):
        """Distinct rows; with columns, the first row of each key with all its columns."""
        if not selection:
            return self._with(self.df.dropDuplicates(self.columns))
        names = resolve(self.schema, selection)
        if not self.order:
            return self._with(self.df.dropDuplicates(names))
        r = temp("r")
        order = Context(self.df, (), self.order, "row").sort()
        return self._with(self.df.withColumn(r, F.row_number().over(Window.partitionBy(*[quote(n) for n in names]).orderBy(*order))).where(F.col(r) == 1).drop(r))

    def drop_missing(self, *selection):
        names = resolve(self.schema, selection, default_all=True)
        return self._with(self.df.where(functools.reduce(operator.and_, [quote(n).isNotNull() for n in names])))

    def fill_missing(self, *selection, direction: str = "down"):
        """Carry the last (down) or next (up) value into missing ones, within groups."""
        if direction not in ("down", "up"):
            raise ValueError('direction is "down" or "up"')
        names = [n for n in resolve(self.schema, selection, default_all=True) if n not in self.groups]
        ctx = Context(self.df, self.groups, self.order, "row")
        w = ctx.window().orderBy(*ctx.sort())
        if direction == "down":
            fill = {n: F.last(quote(n), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in names}
        else:
            fill = {n: F.first(quote(n), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for n in names}
        return self._with(self.df.withColumns(fill))


