"""Each query with SQL against DuckDB on the small tables; small frames' properties."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import verbena as v
from verbena import c
from verbena.plans import queries as Q


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, data, duck, name):
    df = Q.queries()[name](spark, data)
    names = sorted(df.columns)
    got = sorted("|".join(plain(r[n]) for n in names) for r in df.collect())
    out = duck.execute(Q.oracle_sql()[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == names
    want = sorted("|".join(plain(r[at.index(n)]) for n in names) for r in out.fetchall())
    assert got == want


rows_ = st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows_)
def test_properties(spark, rows):
    f = v.from_rows(spark, rows, "k string, x bigint")
    yes, no = f.filter(c.x > 0).nrow(), f.filter(~(c.x > 0)).nrow()
    assert yes + no + f.filter(v.ismissing(c.x)).nrow() == len(rows)
    assert sum(f.count("k").pull("n")) == len(rows)
    assert f.slice(1).rows() + f.slice(-1).rows() == rows
    assert sorted(map(str, f.nest(d=["x"]).unnest_longer("d").mutate(x=v.field(c.d, "x")).select("k", "x").rows())) == sorted(map(str, rows))
    other = f.filter(c.k == "a").select("k").distinct()
    assert f.semi_join(other).nrow() + f.anti_join(other).nrow() == len(rows)
