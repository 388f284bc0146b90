"""The functions of tidy expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import PandasUDFType

from .expr import Expr, Vector, as_expr, lit, scalar

# ---- missing values -------------------------------------------------------

class Skip(Expr):
    """skipmissing(x): aggregates over it ignore missing values."""


def skipmissing(x) -> Expr:
    return Skip("scalar", lambda _c, a: a, (x,), "skipmissing")


def passmissing(fn):
    """Spark functions are missing for missing input already."""
    return fn


def _guarded(fn, name: str, empty=None):
    """An aggregate that is missing when any value is, unless its argument is skipmissing()."""

    def make(x, *more) -> Expr:
        x = as_expr(x)
        if isinstance(x, Skip):
            skip = (lambda ctx, a, *m: ctx.lift(fn(a, *m))) if empty is None else (lambda ctx, a, *m: F.coalesce(ctx.lift(fn(a, *m)), F.lit(empty)))
            return Expr("agg", skip, (x, *more), f"{name}_skipmissing")
        return Expr("agg", lambda ctx, a, *m: F.when(ctx.lift(F.count(a)) == ctx.lift(F.count(F.lit(1))), ctx.lift(fn(a, *m))), (x, *more), name)

    make.__name__ = name
    return make


mean = _guarded(F.avg, "mean")
std = _guarded(F.stddev_samp, "std")
var = _guarded(F.var_samp, "var")
median = _guarded(F.median, "median")
minimum = _guarded(F.min, "minimum")
maximum = _guarded(F.max, "maximum")
_sum = _guarded(F.sum, "sum", 0)
_quantile = _guarded(lambda a, p: F.percentile(a, p), "quantile")
iqr = _guarded(lambda a: F.percentile(a, F.lit(0.75)) - F.percentile(a, F.lit(0.25)), "iqr")


def sum_(x) -> Expr:
    """Sum; conditions count as 0 and 1."""
    e = as_expr(x)
    if e.name in ("eq", "ne", "lt", "le", "gt", "ge", "and", "or", "not", "in", "ismissing"):
        e = Expr("scalar", lambda _c, a: a.cast("int"), (e,), "int")
    return _sum(e)


def quantile(x, p: float) -> Expr:
    return _quantile(x, lit(p))


def cor(x, y) -> Expr:
    return Expr("agg", lambda ctx, a, b: ctx.lift(F.corr(a, b)), (x, y), "cor")


def cov(x, y) -> Expr:
    return Expr("agg", lambda ctx, a, b: ctx.lift(F.covar_samp(a, b)), (x, y), "cov")


def mad(x) -> Expr:
    """Median absolute deviation; the inner median is staged as a column."""
    return median(abs(as_expr(x) - median(x)))


def length(_x=None) -> Expr:
    return Expr("agg", lambda ctx: ctx.lift(F.count(F.lit(1))), (), "length")


def n() -> Expr:
    return Expr("agg", lambda ctx: ctx.lift(F.count(F.lit(1))), (), "n")


nrow = n


def proprow() -> Expr:
    return Expr("agg", lambda ctx: ctx.lift(F.count(F.lit(1))) / ctx.total(), (), "proprow")


def n_distinct(x) -> Expr:
    """length(unique(x)): missing counts as one value."""
    return Expr("agg", lambda ctx, a: ctx.distinct(a) + F.coalesce(ctx.lift(F.max(F.when(a.isNull(), 1))), F.lit(0)), (x,), "n_distinct")


def unique(x) -> Expr:
    return Expr("agg", lambda ctx, a: ctx.lift(F.collect_set(a)), (x,), "unique")


def _ordered(fn, name: str):
    return lambda x: Expr("agg", lambda ctx, a: fn(ctx, a), (x,), name)


first = _ordered(lambda ctx, a: ctx.lift(F.min(F.struct(*ctx.order_key(), a.alias("__v")))).getField("__v"), "first")
last = _ordered(lambda ctx, a: ctx.lift(F.max(F.struct(*ctx.order_key(), a.alias("__v")))).getField("__v"), "last")


def argmin(x) -> Expr:
    """1-based position of the first smallest value; missing values are passed over, and without others it is missing."""
    return Expr("agg", lambda ctx, a, r: ctx.lift(F.min_by(r, F.when(a.isNotNull(), F.struct(a, r)))), (x, row_number()), "argmin")


def argmax(x) -> Expr:
    return Expr("agg", lambda ctx, a, r: ctx.lift(F.max_by(r, F.when(a.isNotNull(), F.struct(a, -r)))), (x, row_number()), "argmax")


#: User functions by name, which parse() finds: name -> function of expressions.
REGISTERED: dict = {}


def register(name: str, fn) -> None:
    """Make a function of expressions known to parse() by name."""
    REGISTERED[name] = fn


def user_agg(fn, returns: str = "double", name: str | None = None):
    """A Python function of pandas Series as an aggregate (grouped-aggregate pandas UDF); with name, parse() knows it."""
    udf = F.pandas_udf(fn, returns, PandasUDFType.GROUPED_AGG)
    return _user("agg", lambda ctx, *a: ctx.lift(udf(*a), by_window=True), fn, name)


def user_fn(fn, returns: str = "double", name: str | None = None):
    """A plain Python function, called for each row's values, as a function of expressions; values travel in Arrow batches.

    vectorized_fn() takes a function of pandas Series, which costs far less.
    """
    udf = F.udf(fn, returns, useArrow=True)
    return _user("scalar", lambda _c, *a: udf(*a), fn, name)


def vectorized_fn(fn, returns: str = "double", name: str | None = None):
    """A function of pandas Series that gives a Series of the same length, as a function of expressions."""
    udf = F.pandas_udf(fn, returns, PandasUDFType.SCALAR)
    return _user("scalar", lambda _c, *a: udf(*a), fn, name)


def _user(kind: str, build, fn, name: str | None):
    label = name or getattr(fn, "__name__", "function")

    def make(*args):
        return Expr(kind, build, args, label)

    make.__name__ = label
    if name:
        register(name, make)
    return make


# ---- windows ---------------------------------------------------------------

def _window(fn, name: str):
    return lambda *args: Expr("window", fn, args, name)


row_number = _window(lambda ctx: ctx.over_ordered(F.row_number()), "row_number")


def lag(x, k: int = 1, default=None) -> Expr:
    return Expr("window", lambda ctx, a: ctx.over_ordered(F.lag(a, k, default)), (x,), "lag")


def lead(x, k: int = 1, default=None) -> Expr:
    return Expr("window", lambda ctx, a: ctx.over_ordered(F.lead(a, k, default)), (x,), "lead")


cumsum = _window(lambda ctx, a: ctx.running(F.sum(a)), "cumsum")
cumprod = _window(lambda ctx, a: ctx.running(F.product(a)), "cumprod")


def accumulate(op, x) -> Expr:
    """Running op: +, *, min and max are window aggregates."""
    known = {operator.add: F.sum, operator.mul: F.product, min: F.min, max: F.max, "+": F.sum, "*": F.product, "min": F.min, "max": F.max}
    if op not in known:
        return Expr("window", lambda ctx, a: F.reduce(F.slice(ctx.running(F.collect_list(a)), 2, 1 << 30), F.element_at(ctx.running(F.collect_list(a)), 1), op), (x,), "accumulate")
    return Expr("window", lambda ctx, a: ctx.running(known[op](a)), (x,), "accumulate")


def ntile(x, buckets: int) -> Expr:
    """Bucket of each value by rank, larger buckets first; missing stays missing."""
    if buckets <= 0:
        raise ValueError("ntile needs a positive number of buckets")
    return Expr("window", lambda ctx, a: F.when(a.isNotNull(), ctx.over_by(F.ntile(buckets), [a.isNull()], [a.asc()])), (x,), "ntile")


# ---- conditions, missing values, conversions ------------------------------

def if_else(cond, yes, no, miss=None) -> Expr:
    return Expr("scalar", lambda _c, p, a, b, m: F.when(p.isNull(), m).when(p, a).otherwise(b), (cond, yes, no, miss), "if_else")


def case_when(*pairs) -> Expr:
    """case_when((condition, value), ...): the first true one, else missing."""
    flat = [x for pair in pairs for x in pair]

    def build(_c, *a):
        out = F.when(a[0], a[1])
        for p, v in zip(a[2::2], a[3::2]):
            out = out.when(p, v)
        return out

    return Expr("scalar", build, flat, "case_when")


missing_if = scalar(lambda a, v: F.nullif(a, v), "missing_if")
replace_missing = scalar(lambda a, v: F.coalesce(a, v), "replace_missing")
coalesce = scalar(F.coalesce, "coalesce")
ismissing = scalar(lambda a: a.isNull(), "ismissing")


def in_(x, values) -> Expr:
    """Membership in a set: missing is only in a set that holds missing; the answer is never missing."""
    values = list(values) if not isinstance(values, range) else values
    if isinstance(values, range) and values.step == 1:
        return Expr("scalar", lambda _c, a: F.coalesce(a.between(values.start, values.stop - 1) & (a == F.floor(a)), F.lit(False)), (x,), "in")
    there, missing = [v for v in values if v is not None], any(v is None for v in values)

    def build(_c, a):
        known = F.coalesce(a.isin(there), F.lit(False)) if there else F.lit(False)
        return (known | a.isNull()) if missing else known

    return Expr("scalar", build, (x,), "in")


def not_in(x, values) -> Expr:
    return ~in_(x, values)


def chain(*parts) -> Expr:
    """chain(3, "<=", c.a, "<", 5) is 3 <= a and a < 5."""
    ops = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
    tests = [ops[parts[i + 1]](as_expr(parts[i]), as_expr(parts[i + 2])) for i in range(0, len(parts) - 2, 2)]
    return functools.reduce(operator.and_, tests)


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(Infinity|Inf|NaN)\s*$"


def _parsed(text):
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _floored(a):
    """Floor as a bigint, missing where it doesn't fit."""
    return F.when((a >= F.lit(-(2.0**63))) & (a < F.lit(2.0**63)), F.floor(a).cast("bigint"))


def _to_double(ctx, a):
    kind = ctx.kind(a)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return a.cast("double")
    return _parsed(a.cast("string"))


def _to_integer(ctx, a):
    """Floor, like a conversion by way of a float; what is a whole number skips it, so that it stays exact."""
    kind = ctx.kind(a)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return a.cast("bigint")
    if isinstance(kind, T.FractionalType):
        return F.floor(a).try_cast("bigint") if isinstance(kind, T.DecimalType) else _floored(a)
    text = a.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?\d{1,19}\s*$"), F.trim(text).try_cast("bigint")).otherwise(_floored(_parsed(text)))


def as_float(x) -> Expr:
    """Numbers and booleans as doubles; text that isn't a number, and other types, are missing."""
    return Expr("scalar", _to_double, (x,), "as_float")


def as_integer(x) -> Expr:
    return Expr("scalar", _to_integer, (x,), "as_integer")


as_string = scalar(lambda a: a.cast("string"), "as_string")

# ---- strings and numbers ---------------------------------------------------

upper, lower, trim, reverse = (scalar(f, f.__name__) for f in (F.upper, F.lower, F.trim, F.reverse))
uppercase, lowercase, strip = upper, lower, trim
nchar = scalar(F.length, "nchar")
string = scalar(lambda *a: F.concat(*[x.cast("string") for x in a]), "string")
str_starts = scalar(F.startswith, "starts_with")
str_ends = scalar(F.endswith, "ends_with")
str_contains = scalar(F.contains, "contains")
str_matches = scalar(F.rlike, "matches")
replace = scalar(F.replace, "replace")


def regexp_replace(x, pattern: str, by: str) -> Expr:
    return Expr("scalar", lambda _c, a: F.regexp_replace(a, pattern, by), (x,), "replace")


def split(x, pattern: str) -> Expr:
    return Expr("scalar", lambda _c, a: F.split(a, pattern), (x,), "split")


def substring(x, start: int, size: int) -> Expr:
    return Expr("scalar", lambda _c, a: F.substring(a, start, size), (x,), "substring")


def pad(x, width: int, fill: str = " ", left: bool = True) -> Expr:
    return Expr("scalar", lambda _c, a: (F.lpad if left else F.rpad)(a, width, fill), (x,), "pad")


def sprintf(pattern: str, *args) -> Expr:
    return Expr("scalar", lambda _c, *a: F.format_string(pattern, *a), args, "sprintf")


sqrt, exp, floor, ceil, sign, sin, cos, tan = (scalar(f, f.__name__) for f in (F.sqrt, F.exp, F.floor, F.ceil, F.sign, F.sin, F.cos, F.tan))
log = scalar(lambda a: F.ln(a), "log")
log2, log10, absolute = scalar(F.log2, "log2"), scalar(F.log10, "log10"), scalar(F.abs, "abs")
pi = lit(3.141592653589793)


def round_(x, digits: int = 0) -> Expr:
    """Half to even."""
    return Expr("scalar", lambda _c, a: F.bround(a, digits), (x,), "round")


def rand(seed: int | None = None) -> Expr:
    return Expr("scalar", lambda _c: F.rand(seed), (), "rand")


def field(x, name: str) -> Expr:
    """A field of a record."""
    return Expr("scalar", lambda _c, a: a.getField(name), (x,), name)


def scalar_(fn):
    """Any function of Columns as a function of expressions."""
    return scalar(fn, getattr(fn, "__name__", "function"))


def vector(*items) -> Vector:
    return Vector(items)


def transform(x, fn) -> Expr:
    """A comprehension over an array column: fn takes and gives a Column."""
    return Expr("scalar", lambda _c, a: F.transform(a, fn), (x,), "transform")


# ---- column predicates -----------------------------------------------------

def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.IntegralType, T.BooleanType))


def is_string(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


# ---- across ----------------------------------------------------------------

class Across:
    def __init__(self, columns, fns):
        self.columns = columns
        self.fns = list(fns) if isinstance(fns, (list, tuple)) else [fns]


def across(columns, fns) -> Across:
    """One expression for each function and column, function by function; names are {column}_{function}.

    A function of two arguments, across(cols, lambda x: f(x, c.w)), is passed
    as weighted(f, "w").
    """
    return Across(columns, fns)


class Weighted:
    def __init__(self, fn, weight: str):
        self.fn, self.weight = fn, weight


def weighted(fn, weight: str) -> Weighted:
    return Weighted(fn, weight)


def compose(*fns):
    """compose(mean, skipmissing) is mean of skipmissing, named mean_skipmissing."""

    def run(x):
        for f in reversed(fns):
            x = f(x)
        return x

    run.__name__ = "_".join(function_name(f) for f in fns)
    return run


def function_name(fn) -> str:
    name = getattr(fn, "__name__", "function")
    return "function" if name == "<lambda>" else name.rstrip("_")


def desc(column) -> tuple:
    return ("desc", column if isinstance(column, str) else column.column)


__all__ = [k for k in dict(globals()) if not k.startswith("_") and k not in ("F", "T", "annotations", "functools", "operator", "scalar")]
