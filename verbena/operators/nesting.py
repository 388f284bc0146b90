"""nest, unnest_longer, unnest_wider."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote
from ..plans.context import temp
from .reshape import MAX_NAMES
from .selection import resolve


def _field(name: str):
    return lambda record: record.getField(name)


class Nesting:
    def nest(self, **new):
        """nest(name=selection, ...): the selected columns of each combination of the others as a list of records."""
        picked = {k: resolve(self.schema, v if isinstance(v, (list, tuple)) else [v]) for k, v in new.items()}
        inside = {n for v in picked.values() for n in v}
        rest = [n for n in self.columns if n not in inside]
        order = [(quote(n).cast("double") * -1 if d else quote(n)).alias(f"__k{i}") for i, (n, d) in enumerate(self.order)]
        cells = []
        for k, names in picked.items():
            record = F.struct(*[quote(n).alias(n) for n in names])
            if order:  # records in row order
                sorted_ = F.array_sort(F.collect_list(F.struct(*order, record.alias("__r"))))
                cells.append(F.transform(sorted_, lambda x: x.getField("__r")).alias(k))
            else:
                cells.append(F.collect_list(record).alias(k))
        out = self.df.groupBy(*[quote(n) for n in rest]).agg(*cells)
        return self._with(out, groups=tuple(g for g in self.groups if g in rest), order=tuple(o for o in self.order if o[0] in rest))

    def unnest_longer(self, *selection, keep_empty: bool = False, indices_include: bool = False):
        """One row for each element. Several columns are recycled to the longest of the row; a missing or empty cell
        drops its row unless keep_empty; indices_include adds {column}_id, from 1."""
        names = resolve(self.schema, selection)
        kinds = {f.name: f.dataType for f in self.schema}
        arrays = {}
        for n in names:
            if isinstance(kinds[n], T.ArrayType):
                arrays[n] = quote(n)
            elif isinstance(kinds[n], T.StructType):
                fields = kinds[n].fields
                common = len({f.dataType for f in fields}) == 1
                arrays[n] = F.when(quote(n).isNotNull(), F.array(*[quote(n).getField(f.name) if common else quote(n).getField(f.name).cast("string") for f in fields]))
            elif isinstance(kinds[n], T.MapType):
                arrays[n] = F.map_entries(quote(n))
            else:
                arrays[n] = F.array(quote(n))
        temps = {n: temp("u") for n in names}
        df = self.df.withColumns({temps[n]: F.coalesce(arrays[n], F.array()) for n in names})
        size = {n: F.size(F.col(temps[n])) for n in names}
        longest = F.greatest(*size.values()) if len(names) > 1 else size[names[0]]
        place = temp("o")
        each = F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>"))
        df = df.select("*", (F.explode_outer(each) if keep_empty else F.explode(each)).alias(place))
        cell = {n: F.when(size[n] > 0, F.get(F.col(temps[n]), F.pmod(F.col(place) - 1, F.greatest(size[n], F.lit(1))))) for n in names}
        columns = [cell[n].alias(n) if n in names else quote(n) for n in self.df.columns]
        if indices_include:
            columns += [F.when(size[n] > 0, F.col(place).cast("bigint")).alias(f"{n}_id") for n in names]
        order = (*self.order, (place, False)) if self.order and not any(o in names for o, _ in self.order) else ()
        out = df.select(*columns, *([F.col(place)] if order else []))
        return self._with(out, order=order)

    def unnest_wider(self, *selection, names_sep: str | None = "_", names: list[str] | None = None, width: int | None = None):
        """One column for each field, key or place of a cell: records by field, lists of records as one list a field,
        maps by key, arrays by place up to the longest. names= (map keys) and width= (array length) skip the job that
        finds them; found keys are sorted. names_sep=None uses the bare key."""
        out = self.df
        for n in resolve(self.schema, selection):
            kind, x = self._type(n), quote(n)
            label = lambda k, n=n: f"{n}{names_sep}{k}" if names_sep is not None else str(k)
            if isinstance(kind, T.StructType):
                cells = [x.getField(f.name).alias(label(int(f.name[1:]) if f.name.startswith("_") and f.name[1:].isdigit() else f.name)) for f in kind.fields]
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                cells = [F.transform(x, _field(f.name)).alias(label(f.name)) for f in kind.elementType.fields]
            elif isinstance(kind, T.MapType):
                keys = names
                if keys is None:
                    found = out.select(F.explode(F.map_keys(x)).alias("k")).distinct().orderBy("k").limit(MAX_NAMES + 1).collect()
                    if len(found) > MAX_NAMES:
                        raise ValueError(f"more than {MAX_NAMES} keys; give names=")
                    keys = [r["k"] for r in found]
                cells = [F.try_element_at(x, F.lit(k)).alias(label(k)) for k in keys]
            elif isinstance(kind, T.ArrayType):
                size = width if width is not None else out.agg(F.max(F.size(x))).first()[0] or 0
                cells = [F.get(x, F.lit(i)).alias(label(i + 1)) for i in range(max(0, size))]
            else:
                raise TypeError(f"{n} is not nested")
            out = out.select(*[quote(c) for c in out.columns if c != n], *cells)
        return self._with(out, groups=tuple(g for g in self.groups if g in out.columns), order=tuple(o for o in self.order if o[0] in out.columns))
