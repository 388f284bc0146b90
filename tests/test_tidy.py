"""Golden rows of the verbs on small frames, nulls and order included."""

import re

import pytest
from pyspark.sql import types as T

import verbena as v
from verbena import c


@pytest.fixture(scope="module")
def abc(spark):
    return v.from_rows(spark, [(x, i, i + 10) for i, x in enumerate("abcde", 1)], "a string, b bigint, c bigint")


@pytest.fixture(scope="module")
def holes(spark):
    return v.from_rows(spark, [(1,), (2,), (None,), (4,), (5,)], "a bigint")


@pytest.fixture(scope="module")
def threes(spark):
    return v.from_rows(spark, [(x, i, i + 10) for i, x in enumerate("abc" * 3, 1)], "a string, b bigint, c bigint")


def test_selection_grammar(abc):
    for what, want in [
        (["a"], ["a"]), ([c.b, "a"], ["b", "a"]), (["a:b"], ["a", "b"]), ([1, 3], ["a", "c"]), ([-1], ["b", "c"]), (["-(a, b)"], ["c"]), ([-v.between("a", "b")], ["c"]),
        ([["c", "a"]], ["c", "a"]), ([v.starts_with("b"), v.everything()], ["b", "a", "c"]), ([-v.contains("b")], ["a", "c"]), ([v.where(v.is_string)], ["a"]), ([v.where(v.is_number)], ["b", "c"]),
        ([v.matches("^[AB]$", "i")], ["a", "b"]), (["!a"], ["b", "c"]), ([-c.a], ["b", "c"]), ([v.not_("a", "c")], ["b"]), ([c["a":"b"]], ["a", "b"]), ([":"], ["a", "b", "c"]), (["1:2"], ["a", "b"]),
    ]:
        assert abc.select(*what).columns == want, what
    with pytest.raises(IndexError):
        abc.select(0)
    with pytest.raises(KeyError):
        abc.select("zz")


def test_projection(abc):
    assert abc.select(x="a", y=c.b * 2).rows()[:2] == [("a", 2), ("b", 4)]
    out = abc.mutate(b=c.b * 10, old=c.b, d=c.b - v.mean(c.b))
    assert out.columns == ["a", "b", "c", "old", "d"] and out.rows()[0] == ("a", 10, 11, 1, -2.0)
    assert abc.rename(z="a").columns == ["z", "b", "c"]
    assert abc.rename_with(str.upper).columns == ["A", "B", "C"]
    assert abc.relocate("c").columns == ["c", "a", "b"]
    assert abc.relocate("a", after="c").columns == ["b", "c", "a"]
    assert abc.pull("b") == [1, 2, 3, 4, 5] and abc.pull(1) == list("abcde")
    assert abc.mutate(d=v.vector(9, 8, 7, 6, 5)).pull("d") == [9, 8, 7, 6, 5]


def test_relocate_gathers_anchors(spark):
    f = v.tidy(spark.createDataFrame([(1, 2, "x", bytearray(b"d"), 3, "y")], T.StructType([T.StructField(n, t) for n, t in zip("ABCDEF", [T.LongType(), T.LongType(), T.StringType(), T.BinaryType(), T.LongType(), T.StringType()])])))
    assert f.relocate(v.where(v.is_string), before=v.where(v.is_integer)).columns == ["C", "F", "A", "B", "E", "D"]
    with pytest.raises(ValueError):
        f.relocate("A", before="B", after="C")


def test_clean_names(spark):
    f = v.tidy(spark.createDataFrame([(1, 2)], [" A bad column name ", "otherName"]))
    assert f.clean_names().columns == ["a_bad_column_name", "other_name"]
    assert f.clean_names("camelCase").columns == ["aBadColumnName", "otherName"]
    with pytest.raises(ValueError):
        f.clean_names("x")


def test_filter(abc, holes):
    assert abc.filter(c.b >= v.mean(c.b)).pull("a") == list("cde")
    assert abc.filter(v.row_number() <= 2).pull("a") == ["a", "b"]
    assert holes.filter(c.a > 1).pull("a") == [2, 4, 5]
    assert holes.filter(v.not_in(c.a, [1, 2])).pull("a") == [None, 4, 5]
    assert holes.filter(v.in_(c.a, [1, None])).pull("a") == [1, None]
    assert abc.filter(v.parse("2 <= b < 4 and a in ('b', 'c', 'd')")).pull("a") == ["b", "c"]
    assert abc.filter(v.chain(2, "<", c.b, "<=", 4)).pull("b") == [3, 4]
    assert abc.filter(c.b > 1, c.b > v.mean(c.b)).pull("b") == [4, 5]  # the mean is over all rows


def test_conditions(holes):
    assert holes.mutate(x=v.if_else(c.a >= 3, "yes", "no")).pull("x") == ["no", "no", None, "yes", "yes"]
    assert holes.mutate(x=v.if_else(c.a >= 3, "yes", "no", "?")).pull("x") == ["no", "no", "?", "yes", "yes"]
    assert holes.mutate(x=v.case_when((c.a > 4, "hi"), (c.a > 1, "mid"))).pull("x") == [None, "mid", None, "mid", "hi"]
    assert holes.mutate(x=v.replace_missing(c.a, 0), y=v.missing_if(c.a, 1)).rows()[:3] == [(1, 1, None), (2, 2, 2), (None, 0, None)]


def test_aggregates_and_missing(holes):
    r = holes.summarize(a=v.mean(c.a), b=v.mean(v.skipmissing(c.a)), s=v.sum_(v.skipmissing(c.a)), n=v.n(), u=v.n_distinct(c.a), m=v.mad(v.skipmissing(c.a)))
    assert r.rows()[0][:5] == (None, 3.0, 12, 5, 5)
    assert holes.filter(v.ismissing(c.a)).summarize(s=v.sum_(v.skipmissing(c.a))).rows() == [(0,)]
    assert holes.mutate(z=c.a / 0).pull("z")[0] is None


def test_conversions(spark):
    f = v.from_rows(spark, [("2.5",), ("letters",), ("-1.5",), (None,), ("1.5d",), ("7",), ("Infinity",)], "s string")
    assert f.mutate(i=v.as_integer(c.s)).pull("i") == [2, None, -2, None, None, 7, None]
    assert f.mutate(d=v.as_float(c.s)).pull("d")[:5] == [2.5, None, -1.5, None, None]
    assert f.mutate(t=v.as_string(v.as_integer(c.s))).pull("t")[0] == "2"


def test_slices(threes, abc):
    assert threes.slice(1, 5).pull("b") == [1, 5]
    assert threes.slice(5, 1, 5).pull("b") == [5, 1, 5]
    assert threes.slice(range(2, 5)).pull("b") == [2, 3, 4]
    assert threes.slice("n").pull("b") == [9]
    assert threes.slice(-1, -2).pull("b") == [3, 4, 5, 6, 7, 8, 9]
    g = threes.group_by("a")
    assert sorted(g.slice(1).pull("b")) == [1, 2, 3] and sorted(g.slice("n").pull("b")) == [7, 8, 9] and sorted(g.slice(-1).pull("b")) == [4, 5, 6, 7, 8, 9]
    assert threes.slice_head(n=2).pull("b") == [1, 2] and threes.slice_tail(n=2).pull("b") == [8, 9] and threes.slice_head(prop=1.0).nrow() == 9
    assert threes.head(4).pull("b") == [1, 2, 3, 4]
    assert threes.slice_sample(n=4).nrow() == 4 and threes.slice_sample(prop=0.5).nrow() == 4 and threes.slice_sample(n=20, replace=True).nrow() == 20
    assert g.slice_sample(n=2).nrow() == 6
    for bad in (lambda: threes.slice(1, -1), lambda: threes.slice(0), lambda: threes.slice_sample(), lambda: threes.slice_head(prop=2)):
        with pytest.raises(ValueError):
            bad()


def test_slice_max(spark):
    f = v.from_rows(spark, [(x,) for x in (1.0, 7.0, 6.0, None, 7.0, 6.0, 2.0, 3.0)], "b double")
    assert f.slice_max("b").pull("b") == [7.0, 7.0]
    assert f.slice_max("b", with_ties=False).pull("b") == [7.0]
    assert f.slice_max("b", n=3).pull("b") == [7.0, 7.0, 6.0]  # ties count at the extreme only
    assert f.slice_max("b", prop=0.5).pull("b") == [7.0, 7.0, 6.0]
    assert f.slice_min("b", n=2).pull("b") == [1.0, 2.0]
    with pytest.raises(ValueError):
        f.slice_max("b", prop=2)


def test_order(spark, holes):
    assert holes.arrange("a").pull("a") == [1, 2, 4, 5, None]
    assert holes.arrange(v.desc("a")).pull("a") == [None, 5, 4, 2, 1]
    f = v.tidy(spark.createDataFrame([(2,), (1,)], "x bigint"))
    with pytest.raises(v.OrderRequired):
        f.slice(1)
    with pytest.raises(v.OrderRequired):
        f.mutate(r=v.row_number())
    g = f.arrange("x").mutate(x=-c.x)  # the order outlives its column
    assert g.pull("x") == [-1, -2]
    assert v.tidy(spark.range(5).toDF("x"), assume_order=True).slice(2).nrow() == 1


def test_distinct_and_missing(spark):
    f = v.from_rows(spark, [("a", 1), ("b", 2), ("a", 3), ("b", 2)], "k string, x bigint")
    assert f.distinct("k").rows() == [("a", 1), ("b", 2)]
    assert sorted(f.distinct().rows()) == [("a", 1), ("a", 3), ("b", 2)]
    m = v.from_rows(spark, [(1, 1), (2, None), (None, 3), (4, 4)], "a bigint, b bigint")
    assert m.drop_missing().rows() == [(1, 1), (4, 4)] and m.drop_missing("a").nrow() == 3
    f = v.from_rows(spark, [(None, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "y")], "a bigint, g string")
    assert f.fill_missing("a").pull("a") == [None, 1, 1, 1, 2]
    assert f.fill_missing("a", direction="up").pull("a") == [1, 1, 2, 2, 2]
    assert f.group_by("g").fill_missing().pull("a") == [None, 1, 1, None, 2]
    with pytest.raises(ValueError):
        f.fill_missing("a", direction="left")


def test_groups(threes):
    g = threes.group_by("a", "b")
    assert g.groups == ("a", "b") and g.summarize(n=v.n()).groups == ("a",) and g.ungroup().groups == ()
    assert sorted(threes.group_by(k=v.upper(c.a)).summarize(s=v.sum_(c.b)).rows()) == [("A", 12), ("B", 15), ("C", 18)]
    assert sorted(threes.group_by("a").mutate(d=c.b - v.mean(c.b)).ungroup().pull("d")) == [-3.0] * 3 + [0.0] * 3 + [3.0] * 3
    assert sorted(threes.group_by("a").summarize(q=v.vector(v.minimum(c.b), v.maximum(c.b))).rows()) == [("a", 1), ("a", 7), ("b", 2), ("b", 8), ("c", 3), ("c", 9)]
    assert sorted(threes.group_by("a").summarize(f=v.first(c.b), l=v.last(c.b), p=v.argmax(c.b)).rows()) == [("a", 1, 7, 3), ("b", 2, 8, 3), ("c", 3, 9, 3)]
    assert sorted(threes.group_by("a").select("b").columns) == ["a", "b"]


def test_count(spark):
    f = v.from_rows(spark, [(x, i) for i, x in enumerate(["a"] * 3 + ["b"] * 3 + ["c", None], 1)], "a string, b bigint")
    assert set(f.count("a").rows()) == {("a", 3), ("b", 3), ("c", 1), (None, 1)}
    assert f.count().rows() == [(8,)] and f.count("a", wt="b", sort=True).rows()[0] == ("b", 15)
    assert f.rename(n="a").count("n").columns == ["n", "nn"]
    assert f.group_by("a").tally().groups == () and f.group_by("a", "b").tally().groups == ("a",)


def test_across(abc):
    assert abc.summarize(v.across(["b", "c"], [v.mean, v.maximum])).columns == ["b_mean", "c_mean", "b_maximum", "c_maximum"]
    assert abc.summarize(v.across("b:c", v.compose(v.mean, v.skipmissing))).columns == ["b_mean_skipmissing", "c_mean_skipmissing"]
    assert abc.mutate(v.across(["b"], lambda x: x * 2)).columns[-1] == "b_function"
    assert abc.summarize(v.across(["b", "c"], v.weighted(lambda x, w: v.sum_(x * w), "c"))).columns == ["b_1"]


def test_windows(spark, abc):
    out = abc.mutate(l=v.lag(c.b), m=v.lead(c.b, 2, 0), s=v.cumsum(c.b), p=v.cumprod(c.b), r=v.row_number() * 2, k=v.n())
    assert out.rows()[2] == ("c", 3, 13, 2, 5, 6, 6.0, 6, 5)
    f = v.from_rows(spark, [(x,) for x in (5, 1, 3, 2, 2, None)], "x bigint")
    assert f.mutate(t=v.ntile(c.x, 2)).pull("t") == [2, 1, 2, 1, 1, None]
    assert v.from_rows(spark, [(i,) for i in range(1, 9)], "x bigint").mutate(t=v.ntile(c.x, 3)).pull("t") == [1, 1, 1, 2, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        v.ntile(c.x, 0)


def test_joins(spark):
    a = v.from_rows(spark, [("a", 1), ("b", 2)], "k string, b bigint")
    b = v.from_rows(spark, [("a", 3), ("c", 4)], "k string, c bigint")
    assert sorted(a.left_join(b).rows()) == [("a", 1, 3), ("b", 2, None)]
    assert sorted(a.right_join(b, "k").rows()) == [("a", 1, 3), ("c", None, 4)]
    assert a.inner_join(b, c.k).rows() == [("a", 1, 3)]
    assert sorted(a.full_join(b).rows()) == [("a", 1, 3), ("b", 2, None), ("c", None, 4)]
    assert a.semi_join(b).rows() == [("a", 1)] and a.anti_join(b).rows() == [("b", 2)]
    assert a.left_join(b.rename(z="k"), {"k": "z"}).columns == ["k", "b", "c"]
    with pytest.raises(v.DuplicateColumn):
        a.left_join(a, "k")
    assert a.left_join(a, "k", suffix=("_x", "_y")).columns == ["k", "b_x", "b_y"]
    with pytest.raises(ValueError):
        a.left_join(b.select(z="c"))
    n = v.from_rows(spark, [(None, 1)], "k string, b bigint")
    m = v.from_rows(spark, [(None, 9)], "k string, c bigint")
    assert n.inner_join(m).rows() == [] and n.inner_join(m, na_matches=True).rows() == [(None, 1, 9)]


def test_binding(spark):
    a, b = v.from_rows(spark, [(1, 2)], "a bigint, b bigint"), v.from_rows(spark, [(3, 4)], "a bigint, c bigint")
    assert sorted(a.bind_rows(b, id="source").rows()) == [(1, 2, None, 1), (3, None, 4, 2)]
    assert a.bind_cols(b).columns == ["a", "b", "a_1", "c"] and a.bind_cols(b).rows() == [(1, 2, 3, 4)]
    with pytest.raises(Exception):
        a.bind_cols(v.from_rows(spark, [(1,), (2,)], "z bigint")).rows()


def test_pivots(spark):
    long = v.from_rows(spark, [(1, "B", 1), (1, "A", 2), (2, "B", 3)], "id bigint, variable string, value bigint")
    wide = long.pivot_wider("variable", "value")
    assert wide.columns == ["id", "B", "A"] and sorted(wide.rows()) == [(1, 1, 2), (2, 3, None)]
    assert sorted(long.pivot_wider("variable", "value", values_fill=0).rows()) == [(1, 1, 2), (2, 3, 0)]
    two = long.mutate(w=c.value * 2).pivot_wider("variable", ["value", "w"])
    assert two.columns == ["id", "B_value", "A_value", "B_w", "A_w"]
    with pytest.raises(Exception):
        long.bind_rows(long).pivot_wider("variable", "value").rows()
    w = v.from_rows(spark, [(1, 1, "x"), (2, 3, "y")], "id bigint, A bigint, B string")
    assert set(w.pivot_longer(-c.id).rows()) == {(1, "A", "1"), (1, "B", "x"), (2, "A", "3"), (2, "B", "y")}


def test_splitting(spark):
    f = v.from_rows(spark, [("1-1",), ("2-2",), ("3-3-3",)], "a string")
    assert f.separate("a", ["b", "c"], "-").rows() == [("1", "1"), ("2", "2"), ("3", "3-3")]
    assert f.separate("a", ["b", "c", "d"], "-").rows()[0] == ("1", "1", None)
    assert f.separate("a", ["b"], re.compile("-+"), extra="drop").rows() == [("1",), ("2",), ("3",)]
    with pytest.raises(Exception):
        f.separate("a", ["b"], "-", extra="error").rows()
    u = v.from_rows(spark, [("a", None), ("b", "x")], "p string, q string")
    assert u.unite("z", ["p", "q"], sep="_").rows() == [("a",), ("b_x",)]
    assert u.unite("z", ["p", "q"], remove=False).columns == ["p", "q", "z"]
    r = v.from_rows(spark, [(1, "a;b", "x;y"), (2, None, None)], "i bigint, p string, q string")
    assert r.separate_rows("p", "q", sep=";").rows() == [(1, "a", "x"), (1, "b", "y"), (2, None, None)]


def test_nesting(spark):
    f = v.from_rows(spark, [("a", 1, 2), ("a", 3, 4), ("b", 5, 6)], "k string, x bigint, y bigint")
    n = f.nest(data=["x", "y"])
    assert sorted(n.rows())[0] == ("a", [(1, 2), (3, 4)])
    assert n.unnest_wider("data").columns == ["k", "data_x", "data_y"]
    e = v.from_rows(spark, [(1, []), (2, [1, 2, 3]), (3, [4, 5]), (4, None)], "x bigint, y array<bigint>")
    assert e.unnest_longer("y").rows() == [(2, 1), (2, 2), (2, 3), (3, 4), (3, 5)]
    assert e.unnest_longer("y", keep_empty=True, indices_include=True).rows()[0] == (1, None, None)
    z = v.from_rows(spark, [(1, [1, 2], [9])], "x bigint, p array<bigint>, q array<bigint>")
    assert z.unnest_longer("p", "q").rows() == [(1, 1, 9), (1, 2, 9)]  # recycled
    assert e.unnest_wider("y").columns == ["x", "y_1", "y_2", "y_3"]
    m = v.from_rows(spark, [(1, {"b": 2, "a": 1}), (2, {"a": 3})], "x bigint, m map<string,bigint>")
    assert m.unnest_wider("m", names_sep=None).rows() == [(1, 1, 2), (2, 3, None)]
    with pytest.raises(TypeError):
        m.unnest_wider("x")


def test_summary_and_glimpse(spark, abc, capsys):
    s = v.from_rows(spark, [(1.0, "x"), (2.0, None), (4.0, "x")], "d double, e string").summary().rows()
    assert s[0][:3] == ("d", 1.0, 1.5) and s[1][1] is None and s[1][7:] == (2, 1, 3, 2)
    assert "Rows: 5" in abc.group_by("a").glimpse() and "Groups: a [5]" in abc.group_by("a").glimpse()
    v.settings(log=True)
    abc.filter(c.b > 2)
    v.settings(log=False)
    assert "removed 2 rows" in capsys.readouterr().out
    with pytest.raises(KeyError):
        v.settings(other=True)


def test_user_aggregate(abc):
    assert abc.summarize(x=v.user_agg(lambda s: float(s.max() - s.min()))(c.b)).rows() == [(4.0,)]


def test_argmin_missing(spark):
    """As in SQL's min_by: missing values are passed over; the first of ties counts."""
    f = v.from_rows(spark, [("a", None), ("a", 2), ("a", 1), ("a", 1), ("a", 2), ("b", None)], "g string, x bigint")
    assert sorted(f.group_by("g").summarize(lo=v.argmin(c.x), hi=v.argmax(c.x)).rows()) == [("a", 3, 2), ("b", None, None)]


def test_grouped_aggregates_without_windows(spark):
    """A grouped aggregate in mutate or filter is joined by the keys, missing and NaN ones too; no task sorts a whole group."""
    from verbena.plans import context

    nan = float("nan")
    rows = [("a", 1.0, 1), (None, 1.0, 2), ("a", 1.0, 3), (None, nan, 4), (None, nan, None), ("b", -0.0, 5), ("b", 0.0, 7)]
    f = v.from_rows(spark, rows, "g string, k double, x bigint").group_by("g", "k")
    m = f.mutate(m=v.mean(c.x), s=v.sum_(v.skipmissing(c.x)), n=v.n(), u=v.n_distinct(c.x), share=v.proprow())
    assert "Window" not in m.df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.g, str(abs(r.k)), r.x): (r.m, r.s, r.n, r.u, round(r.share * 7)) for r in m.ungroup().collect()}
    assert got == {
        ("a", "1.0", 1): (2.0, 4, 2, 2, 2), ("a", "1.0", 3): (2.0, 4, 2, 2, 2), (None, "1.0", 2): (2.0, 2, 1, 1, 1), (None, "nan", 4): (None, 4, 2, 2, 2),
        (None, "nan", None): (None, 4, 2, 2, 2), ("b", "0.0", 5): (6.0, 12, 2, 2, 2), ("b", "0.0", 7): (6.0, 12, 2, 2, 2),
    }
    assert sorted(f.filter(c.x > v.minimum(c.x)).ungroup().pull("x")) == [3, 7]
    assert m.columns == ["g", "k", "x", "m", "s", "n", "u", "share"]
    few, context.FEW = context.FEW, 1  # beyond the bound the join is shuffled, with the same rows
    try:
        many = f.mutate(m=v.mean(c.x), s=v.sum_(v.skipmissing(c.x)), n=v.n(), u=v.n_distinct(c.x), share=v.proprow())
    finally:
        context.FEW = few
    assert sorted(map(str, many.rows())) == sorted(map(str, m.rows()))


def test_mad_without_window(spark):
    f = v.from_rows(spark, [("a", 1), ("a", 3), ("a", 9), (None, 2), (None, 4), ("b", None)], "g string, x bigint").group_by("g")
    mad = f.summarize(d=v.mad(c.x))
    assert "Window" not in mad.df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, mad.rows())) == ["('a', 2.0)", "('b', None)", "(None, 1.0)"]


def _numbered_by(frame) -> list[str]:
    return re.findall(r"row_number\(\) windowspecdefinition\((\w+)#", frame.df._jdf.queryExecution().analyzed().toString())


def test_slice_sample_in_cells(spark):
    """Rows are numbered inside cells of a group; whole shares, equal rows, maps and missing groups included."""
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("x"), F.create_map(F.lit("k"), F.col("id") % 5).alias("m"))
    g = v.tidy(rows).group_by("g")
    sample = g.slice_sample(prop=0.25)
    assert _numbered_by(sample) and all(k.startswith("__verbena_b") for k in _numbered_by(sample))
    assert sorted(map(str, sample.ungroup().count("g").rows())) == ["(0, 250)", "(1, 250)", "(None, 250)"]
    assert sorted(map(str, g.slice_sample(n=1500).ungroup().count("g").rows())) == ["(0, 1000)", "(1, 1000)", "(None, 1000)"]
    assert sample.columns == ["g", "x", "m"] and 300 < sample.ungroup().filter(c.x == 1).nrow() < 450
    ids = v.tidy(spark.range(1000))
    one, two = (set(ids.slice_sample(prop=0.3, seed=s).pull("id")) for s in (1, 2))
    assert len(one) == len(two) == 300 and 50 < len(one & two) < 130
    assert ids.slice_sample(prop=0.0).nrow() == 0 and ids.slice_sample(prop=1.0).nrow() == 1000


def test_slice_sample_replace_in_cells(spark, monkeypatch):
    """Draws are made in spans, any number of them, and fall on all rows of their group."""
    from verbena.operators import rows

    monkeypatch.setattr(rows, "_SPAN", 64)
    g = v.from_rows(spark, [("a", i) for i in range(50)] + [(None, i) for i in range(7)], "g string, x bigint").group_by("g")
    drawn = g.slice_sample(n=300, replace=True)
    assert all(k.startswith("__verbena_b") for k in _numbered_by(drawn))
    by = {r.g: (r.n, r.k) for r in drawn.ungroup().group_by("g").summarize(n=v.n(), k=v.n_distinct(c.x)).collect()}
    assert {k: n for k, (n, _) in by.items()} == {"a": 300, None: 300} and by["a"][1] > 40 and by[None][1] == 7
    assert sorted(map(str, g.slice_sample(prop=2.5, replace=True).ungroup().count("g").rows())) == ["('a', 125)", "(None, 17)"]
    assert g.slice_sample(prop=0.01, replace=True).nrow() == 0


def test_names(spark):
    f = v.tidy(spark.createDataFrame([("x", 1)], ["my name", "my.age"]))
    assert f.mutate(z=c["my.age"] + 1).select("my name", "z").rows() == [("x", 2)]
    with pytest.raises(ValueError):
        v.tidy(spark.createDataFrame([(1, 2)], ["a", "A"]))


def test_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    s = v.read_stream(spark, str(tmp_path / "in"), "id bigint")
    out = s.filter(c.id > 4).mutate(x=c.id * 2)
    q = out.to_spark().writeStream.format("memory").queryName("tidy_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tidy_stream").count() == 5
    with pytest.raises(TypeError):
        s.arrange("id").slice(1)
    with pytest.raises(TypeError):
        s.mutate(m=v.mean(c.id))


def test_io(spark, abc, tmp_path):
    for kind in ("parquet", "json", "csv", "orc"):
        v.write(abc, str(tmp_path / f"t.{kind}"), kind)
        assert v.read(spark, str(tmp_path / f"t.{kind}")).nrow() == 5


def test_plans(abc):
    plan = lambda f: f.to_spark(sort=False)._jdf.queryExecution().executedPlan().toString()
    one = plan(abc.mutate(d=c.b - v.mean(c.b)))
    assert "Window" not in one and "Broadcast" in one
    grouped = plan(abc.group_by("a").mutate(m=v.mean(c.b), x=v.maximum(c.c)))
    assert grouped.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plan(abc.distinct("a"))


def test_change_log(spark, capsys):
    """The messages of the change log, word for word."""
    from verbena.operators.inspect import report, with_copies

    t = v.from_rows(spark, [("a", "A", 1), ("a", "B", 2), ("b", "A", 3), ("b", "B", 4)], "label string, name string, num int")
    assert report("select", t, t.select("name", "num")) == '@select removed: ["label"] '
    assert report("mutate", t, t.mutate(num2=v.vector(2, 3, 4, 5))) == '@mutate: new variable "num2" with 4 unique values and 0.0% missing.'
    assert report("filter", t, t.filter(c.name == "A")) == "@filter: removed 2 rows (50.0%), 2 rows remaining. "
    assert report("transmute", t, t.transmute(labelstring=c.label)) == '@transmute removed: ["label", "name", "num"] \n\t@transmute: new variable "labelstring" with 2 unique values and 0.0% missing. '
    assert report("summarize", t, t.summarize(n=v.sum_(c.num))) == "@summarize returned a DataFrame (1 row, 1 column). "
    grouped = t.group_by("label")
    assert report("group_by", t, grouped) == '@group_by added groups: ["label"]' and report("ungroup", grouped, grouped.ungroup()) == '@ungroup removed groups: ["label"]'
    double = t.bind_rows(t)
    assert report("distinct", double, double.distinct()) == "@distinct: removed 4 rows (50.0%), 4 rows remaining. "
    a, b = v.from_rows(spark, [("a", 1), ("b", 2)], "a string, b int"), v.from_rows(spark, [("a", 3), ("c", 4)], "a string, c int")
    assert report("left_join", a, a.left_join(b, by="a")) == '@left_join: added 1 new column(s): ["c"].\n\t- Dimension Change: 2×2 -> 2×3\n'
    d = v.from_rows(spark, [(0.3,), (2.0,), (None,), (3.0,), (None,), (5.0,), (6.0,), (None,)], "dt2 double")
    assert report("fill_missing", d, with_copies(d).fill_missing("dt2")) == '@fill_missing: changed 3 values (38.0%) of "dt2" (3 replaced missing)'
    u = v.from_rows(spark, [("1", "1", None), ("2", "2", None), ("3", "3", "3")], "b string, c string, d string")
    assert report("unite", u, u.unite("new_col", ["b", "c", "d"], "-")) == '@unite: added variable "new_col" with 3 unique value(s), 0.0% missing\n\t\tremoved 3 columns: ["b", "c", "d"]\n'
    s = v.from_rows(spark, [("1-1",), ("2-2",)], "a string")
    assert report("separate", s, s.separate("a", ["x", "y"], "-")).startswith('@separate added 2 new columns and removed column "a" \n\t- x: 2 unique values, 0.0% missing')
    v.settings(log=True)
    t.mutate(num=c.num + 1)
    v.settings(log=False)
    assert '@mutate: changed 4 values (100.0%) of "num"' in capsys.readouterr().out


def test_visible_positions_and_ranges(spark):
    f = v.from_rows(spark, [(1, "x"), (2, "y")], "a int, b string")
    for wrong in (lambda: f.select(3), lambda: f.select(1, 3)):
        with pytest.raises(IndexError):
            wrong()
    assert f.mutate(v.across(v.where(v.is_number), v.sum_)).columns == ["a", "b", "a_sum"]
    assert f.slice(2).rows() == [(2, "y")]
    for wrong in (f.slice(3), f.slice(1, 3), f.slice(-3)):
        with pytest.raises(Exception, match="beyond the last row"):
            wrong.rows()
    with pytest.raises(ValueError, match="no aggregate"):
        f.group_by("b").summarize(x=c.a)


def test_conversions_by_type(spark):
    f = v.from_rows(spark, [(9223372036854775807, True, float("nan"), "9223372036854775807"), (-5, False, -1.5, " 7.9 "), (None, None, 1e300, "x")], "i bigint, b boolean, d double, s string")
    got = f.transmute(i=v.as_integer(c.i), b=v.as_integer(c.b), d=v.as_integer(c.d), s=v.as_integer(c.s)).rows()
    assert got == [(9223372036854775807, 1, None, 9223372036854775807), (-5, 0, -2, 7), (None, None, None, None)]
    assert f.transmute(b=v.as_float(c.b), s=v.as_float(c.s)).rows()[1:] == [(0.0, 7.9), (None, None)]


def test_stream_guard_across(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = v.tidy(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")))
    with pytest.raises(TypeError):
        stream.mutate(v.across("id", v.mean))
    assert stream.mutate(v.across("id", v.as_string)).columns == ["id", "id_as_string"]


def test_same_plans_as_by_hand(spark, data):
    """The benchmark shapes give the optimized plan of hand-written code."""
    import re

    from pyspark.sql import functions as F
    from verbena.plans.queries import queries

    t = spark.read.parquet(f"{data}/lineitem.parquet")
    hand = {
        "bench_filter": t.where((F.col("l_quantity") > 20) & (F.col("l_discount") > 0.04)),
        "bench_count": t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
        "bench_product": t.select("l_orderkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("cut")),
        "bench_select": t.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    }
    plan = lambda df: re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
    for name, df in hand.items():
        assert plan(queries()[name](spark, data)) == plan(df), name
