"""glimpse, settings and the change log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import quote

_SETTINGS = {"code": False, "log": False}


def settings(**values: bool) -> dict[str, bool]:
    """settings(code=True) prints each verb's plan, settings(log=True) what it changed (which costs counts)."""
    for k, v in values.items():
        if k not in _SETTINGS:
            raise KeyError(f"settings are {sorted(_SETTINGS)}, not {k}")
        _SETTINGS[k] = bool(v)
    return dict(_SETTINGS)


_COLUMNS = {"select", "transmute", "rename", "rename_with", "relocate", "clean_names", "unnest_wider", "pivot_wider", "pivot_longer", "nest", "bind_cols"}
_ROWS = {"filter", "slice", "slice_sample", "slice_max", "slice_min", "slice_head", "slice_tail", "head", "distinct", "drop_missing", "unnest_longer", "separate_rows", "bind_rows"}
_SIZES = {"summarize", "count", "tally", "summary"}
_JOINS = {"left_join", "right_join", "inner_join", "full_join", "semi_join", "anti_join"}
OLD = "__verbena_old_"


def _names(names) -> str:
    return "[" + ", ".join(f'"{n}"' for n in names) + "]"


def _share(part: int, whole: int, digits: int = 0, none=0) -> str:
    return str(round(100 * part / whole, digits) if whole else none)


def _s(n: int, word: str) -> str:
    return f"{n} {word}" + "s" * (n != 1)


def _measure(before, after, added: list[str], changed: list[str]) -> dict:
    """All numbers of a message by one job: rows before and after, of new columns the distinct and missing values, of kept ones what changed."""
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(added):
        x = quote(n)
        value = x if not isinstance(after.schema[n].dataType, T.MapType) else F.to_json(x)
        cells += [(F.count_distinct(value) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))).alias(f"u{i}"), F.count_if(x.isNull()).alias(f"m{i}")]
    for i, n in enumerate(changed):
        new, old = quote(n), quote(OLD + n)
        same = new.eqNullSafe(old) if after.schema[n].dataType == after.df.schema[OLD + n].dataType else new.cast("string").eqNullSafe(old.cast("string"))
        cells += [F.count_if(~same).alias(f"c{i}"), (F.count_if(new.isNull()) - F.count_if(old.isNull())).alias(f"d{i}")]
    return after.df.agg(*cells).crossJoin(before.df.agg(F.count(F.lit(1)).alias("rows_before"))).first().asDict()


def report(verb: str, before, after) -> str:
    """What a verb changed: the message of the change log, made by one job (two frames' aggregates, joined)."""
    name, old, new = f"@{verb}", before.columns, after.columns
    added, removed = [n for n in new if n not in old], [n for n in old if n not in new]
    if verb in ("group_by", "ungroup"):
        gone, come = [g for g in before.groups if g not in after.groups], [g for g in after.groups if g not in before.groups]
        text = f"{name} added groups: {_names(come)}" if come else ""
        return text + (f"{name} removed groups: {_names(gone)}" if gone else "") or "No changes."
    copies = [n for n in new if OLD + n in after.df.columns]
    got = _measure(before, after, added, copies)
    rows, was = got["rows"], got["rows_before"]
    if verb in _JOINS:
        what = f"added {len(added)} new column(s): {_names(added)}." if added else f"removed {len(removed)} column(s): {_names(removed)}."
        return f"{name}: {what}\n\t- Dimension Change: {was}×{len(old)} -> {rows}×{len(new)}\n"
    if verb == "unite":
        text = f'{name}: added variable "{added[0]}" with {got["u0"]} unique value(s), {_share(got["m0"], rows, 1, 0.0)}% missing' if added else f"{name}: no new variable"
        return text + (f"\n\t\tremoved {len(removed)} columns: {_names(removed)}\n" if removed else ".\n")
    if verb == "separate":
        head = f"{name} added {len(added)} new columns" + (f' and removed column "{removed[0]}" \n' if removed else "\n")
        return head + "".join(f"\t- {n}: {got[f'u{i}']} unique values, {_share(got[f'm{i}'], rows)}% missing\n" for i, n in enumerate(added))
    if verb in _SIZES:
        kind = "GroupedDataFrame" if after.groups else "DataFrame"
        return f"{name} returned a {kind} ({_s(rows, 'row')}, {_s(len(new), 'column')}). "
    parts = []
    if verb in _ROWS:
        if rows > was:
            parts.append(f"{name}: added {rows - was} rows ({_share(rows - was, was, none=100)}%), {rows} rows total. ")
        elif rows < was:
            parts.append(f"{name}: removed {was - rows} rows ({_share(was - rows, was, none=100)}%), {rows} rows remaining. ")
    if verb in _COLUMNS and removed:
        parts.append(f"{name} removed: {_names(removed)} ")
    for i, n in enumerate(copies):
        if got[f"c{i}"]:
            d = got[f"d{i}"]
            parts.append(f'{name}: changed {got[f"c{i}"]} values ({_share(got[f"c{i}"], rows)}%) of "{n}"' + (f" ({d} new missing)" if d > 0 else f" ({-d} replaced missing)" if d < 0 else ""))
    end = "" if verb in ("mutate", "fill_missing") else " "
    parts += [f'{name}: new variable "{n}" with {got[f"u{i}"]} unique values and {_share(got[f"m{i}"], rows, 1 if not end else 0)}% missing.{end}' for i, n in enumerate(added) if verb not in _ROWS]
    return "\n\t".join(parts) or "No changes."


def with_copies(frame):
    """The frame with hidden copies of its columns, so that a verb's result holds old and new values side by side."""
    return frame._with(frame.df.withColumns({OLD + n: quote(n) for n in frame.columns if n not in frame.groups}))


class Inspect:
    def glimpse(self, width: int = 80, rows: int = 20) -> str:
        """Sizes, groups and the first values of each column, printed and returned."""
        # one job for the sizes, one for the rows shown
        counts = [F.count(F.lit(1)).alias("rows")] + ([F.count_distinct(F.struct(*[quote(g) for g in self.groups])).alias("groups")] if self.groups else [])
        sizes = self.df.agg(*counts).first()
        sample = self.to_spark().limit(rows).collect()
        lines = [f"Rows: {sizes[0]}", f"Columns: {len(self.columns)}"]
        if self.groups:
            count = sizes[1]
            lines.append(f"Groups: {', '.join(self.groups)} [{count}]")
        for f in self.schema:
            values = ", ".join("missing" if r[f.name] is None else str(r[f.name]) for r in sample)
            lines.append(f".{f.name} {f.dataType.simpleString()} {values}"[:width])
        text = "\n".join(lines)
        print(text)
        return text

    def nrow(self) -> int:
        return self.df.agg(F.count(F.lit(1))).first()[0]

    def ncol(self) -> int:
        return len(self.columns)
