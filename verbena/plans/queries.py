"""Queries of the tidy verbs with their DuckDB SQL, one pair for each operator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library as L
from ..functions.expr import c
from ..functions.parse import parse
from ..operators import selection as S
from ..sources.io import table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name, *order: table(spark, sf_dir, name, order_by=list(order) or None)).to_spark(sort=False)
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship_share"](spark, sf_dir)


def r4(x):
    return L.scalar_(lambda a: F.round(a, 4))(x)


# ---- flagship -----------------------------------------------------------------

@query("""SELECT l_returnflag, l_linestatus, n, round(sum_price, 2) AS sum_price, round(sum_price / sum(sum_price) OVER (PARTITION BY l_returnflag), 4) AS share FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_extendedprice) AS sum_price FROM lineitem WHERE l_quantity >= (SELECT avg(l_quantity) FROM lineitem) GROUP BY 1, 2)""")
def flagship_share(t):
    return (
        t("lineitem").filter(c.l_quantity >= L.mean(c.l_quantity)).group_by("l_returnflag", "l_linestatus")
        .summarize(n=L.n(), sum_price=L.sum_(c.l_extendedprice)).mutate(share=r4(c.sum_price / L.sum_(c.sum_price)), sum_price=L.scalar_(lambda a: F.round(a, 2))(c.sum_price))
        .ungroup().arrange("l_returnflag", "l_linestatus")
    )


# ---- selection and projection -----------------------------------------------------

@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def select_range(t):
    return t("customer").select("c_custkey:c_nationkey")


@query("SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def select_neg(t):
    return t("customer").select(-S.between("c_custkey", "c_name"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def select_helpers(t):
    return t("customer").select(S.ends_with("key"), S.matches("^C_MKT", "i"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_where(t):
    return t("customer").select(S.where(L.is_number))


@query("SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def select_everything(t):
    return t("customer").select("c_mktsegment", S.everything())


@query("SELECT c_custkey, c_nationkey FROM customer")
def select_positions(t):
    return t("customer").select(1, 3)


@query("SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def select_not_contains(t):
    return t("customer").select(-S.contains("key"))


@query("SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer")
def select_rename_compute(t):
    return t("customer").select(id="c_custkey", twice=c.c_acctbal * 2)


@query("SELECT o_orderkey, o_totalprice / 1000 AS k FROM orders")
def transmute_expr(t):
    return t("orders").transmute("o_orderkey", k=c.o_totalprice / 1000)


@query("SELECT o_orderkey + 1 AS o_orderkey, o_orderkey AS old, o_custkey FROM orders")
def mutate_parallel(t):
    return t("orders").select("o_orderkey", "o_custkey").mutate(o_orderkey=c.o_orderkey + 1, old=c.o_orderkey)


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS d FROM orders")
def mutate_grouped_mean(t):
    return t("orders").group_by("o_orderpriority").mutate(d=r4(c.o_totalprice - L.mean(c.o_totalprice))).ungroup().select("o_orderkey", "d")


@query("SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 4) AS d FROM customer")
def mutate_global_mean(t):
    return t("customer").mutate(d=r4(c.c_acctbal - L.mean(c.c_acctbal))).select("c_custkey", "d")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
def rename(t):
    return t("nation").rename(key="n_nationkey", name="n_name")


@query('SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey FROM nation')
def rename_with(t):
    return t("nation").rename_with(str.upper, S.starts_with("n_na"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def relocate(t):
    return t("nation").relocate("n_regionkey", before="n_nationkey")


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name FROM nation")
def clean_names(t):
    return t("nation").select(**{"Nation Key": "n_nationkey", "nationName": "n_name"}).clean_names()


# ---- rows ----------------------------------------------------------------------------

@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_multi(t):
    return t("orders").filter(c.o_totalprice > 100000, c.o_orderstatus == "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE 100000 <= o_totalprice AND o_totalprice < 200000")
def filter_chained(t):
    return t("orders").filter(parse("100000 <= o_totalprice < 200000")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in(t):
    return t("orders").filter(L.in_(c.o_orderstatus, ["F", "P"])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') IN ('F'), false)")
def filter_notin_null(t):
    return t("orders").filter(L.not_in(L.missing_if(c.o_orderstatus, "P"), ["F"])).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY o_totalprice = min(o_totalprice) OVER (PARTITION BY o_orderpriority)")
def filter_grouped_min(t):
    return t("orders").group_by("o_orderpriority").filter(c.o_totalprice == L.minimum(c.o_totalprice)).ungroup().select("o_orderkey", "o_orderpriority")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY event_id) <= 100")
def filter_row_number(t):
    return t("events", "event_id").filter(L.row_number() <= 100).select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def arrange_desc(t):
    return t("orders").arrange(L.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_all(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_keep_first(t):
    return t("events", "event_id").distinct("user_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 10 OFFSET 4")
def slice_pos(t):
    return t("events", "event_id").select("event_id", "user_id").slice(range(5, 15))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY event_id) NOT IN (1, 3, 5)")
def slice_neg(t):
    return t("events", "event_id").slice(-1, -3, -5).select("event_id")


@query("SELECT e.event_id FROM (VALUES (3), (1), (3)) p(k) JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) e ON e.r = p.k")
def slice_dup(t):
    return t("events", "event_id").slice(3, 1, 3).select("event_id")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1")
def slice_last_grouped(t):
    return t("events", "event_id").group_by("event_type").slice("n").ungroup().select("event_id", "event_type")


@query("SELECT p_partkey, p_size FROM part QUALIFY row_number() OVER (ORDER BY p_size DESC, p_partkey) <= greatest(3, (SELECT count(*) FROM part WHERE p_size = (SELECT max(p_size) FROM part)))")
def slice_max_ties(t):
    return t("part", "p_partkey").slice_max("p_size", n=3).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 7")
def slice_min_noties(t):
    return t("part", "p_partkey").slice_min("p_size", n=7, with_ties=False).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= greatest(floor(count(*) OVER (PARTITION BY p_brand) * 0.1), count(*) OVER (PARTITION BY p_brand, p_retailprice) * (max(p_retailprice) OVER (PARTITION BY p_brand) = p_retailprice)::INT)")
def slice_max_prop(t):
    return t("part", "p_partkey").group_by("p_brand").slice_max("p_retailprice", prop=0.1).ungroup().select("p_partkey", "p_brand")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def slice_head_grouped(t):
    return t("events", "event_id").group_by("event_type").slice_head(n=3).ungroup().select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= floor(count(*) OVER (PARTITION BY event_type) * 0.25)")
def slice_tail_prop(t):
    return t("events", "event_id").group_by("event_type").slice_tail(prop=0.25).ungroup().select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 6")
def head_grouped(t):
    return t("events", "event_id").group_by("event_type").head().ungroup().select("event_id", "event_type")


@query("SELECT 50::BIGINT AS n")
def slice_sample_n(t):
    return t("orders").slice_sample(n=50).summarize(n=L.n())


@query("SELECT count(*) AS n FROM (SELECT floor(count(*) * 0.1) AS k, o_orderpriority FROM orders GROUP BY 2), range(1000000) r(i) WHERE i < k")
def slice_sample_prop(t):
    return t("orders").group_by("o_orderpriority").slice_sample(prop=0.1).ungroup().summarize(n=L.n())


@query("SELECT count(*) AS n FROM events WHERE nullif(event_type, 'view') IS NOT NULL")
def drop_missing(t):
    return t("events").mutate(event_type=L.missing_if(c.event_type, "view")).drop_missing("event_type").summarize(n=L.n())


_HOLES = "(SELECT event_id, user_id, nullif(event_type, 'view') AS kind FROM events)"


@query(f"SELECT event_id, last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS kind FROM {_HOLES}")
def fill_down_grouped(t):
    return t("events", "event_id").select("event_id", "user_id", kind=L.missing_if(c.event_type, "view")).group_by("user_id").fill_missing("kind").ungroup().select("event_id", "kind")


@query(f"SELECT event_id, first_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kind FROM {_HOLES}")
def fill_up_grouped(t):
    return t("events", "event_id").select("event_id", "user_id", kind=L.missing_if(c.event_type, "view")).group_by("user_id").fill_missing("kind", direction="up").ungroup().select("event_id", "kind")


# ---- groups and aggregates -------------------------------------------------------------

@query("SELECT lower(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1")
def group_by_expr(t):
    return t("orders").group_by(p=L.lower(c.o_orderpriority)).summarize(n=L.n())


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS m, round(stddev_samp(l_quantity), 4) AS s, round(var_samp(l_tax), 4) AS v, median(l_quantity) AS med, min(l_tax) AS lo, max(l_tax) AS hi, quantile_cont(l_quantity, 0.9) AS q9, (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) AS i, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem GROUP BY 1")
def summarize_multi(t):
    return t("lineitem").group_by("l_returnflag").summarize(
        n=L.n(), m=r4(L.mean(c.l_quantity)), s=r4(L.std(c.l_quantity)), v=r4(L.var(c.l_tax)), med=L.median(c.l_quantity), lo=L.minimum(c.l_tax), hi=L.maximum(c.l_tax),
        q9=L.quantile(c.l_quantity, 0.9), i=L.iqr(c.l_quantity), r=r4(L.cor(c.l_quantity, c.l_extendedprice)),
    )


@query("SELECT l_returnflag, l_linestatus, n, n - min(n) OVER (PARTITION BY l_returnflag) AS over_least FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def summarize_peel(t):
    return t("lineitem").group_by("l_returnflag", "l_linestatus").summarize(n=L.n()).mutate(over_least=c.n - L.minimum(c.n))


@query("SELECT l_returnflag, unnest([min(l_quantity), max(l_quantity)]) AS q FROM lineitem GROUP BY 1")
def summarize_vector(t):
    return t("lineitem").group_by("l_returnflag").summarize(q=L.vector(L.minimum(c.l_quantity), L.maximum(c.l_quantity)))


@query("SELECT l_returnflag, min(l_quantity) AS l_quantity_minimum, min(l_tax) AS l_tax_minimum, max(l_quantity) AS l_quantity_maximum, max(l_tax) AS l_tax_maximum FROM lineitem GROUP BY 1")
def across_min_max(t):
    return t("lineitem").group_by("l_returnflag").summarize(L.across(["l_quantity", "l_tax"], [L.minimum, L.maximum]))


@query("SELECT round(sum(s_acctbal * s_nationkey) / sum(s_nationkey), 4) AS s_acctbal_1 FROM supplier")
def across_weighted(t):
    return t("supplier").summarize(L.across(["s_acctbal"], L.weighted(lambda x, w: r4(L.sum_(x * w) / L.sum_(w)), "s_nationkey")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def count_basic(t):
    return t("orders").count("o_orderstatus", "o_orderpriority")


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS n FROM orders GROUP BY 1")
def count_wt_sort(t):
    return t("orders").count("o_orderstatus", wt="o_totalprice", sort=True).mutate(n=L.scalar_(lambda a: F.round(a, 2))(c.n))


@query("SELECT o_orderstatus AS n, count(*) AS nn FROM orders GROUP BY 1")
def count_nn(t):
    return t("orders").rename(n="o_orderstatus").count("n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def tally(t):
    return t("orders").group_by("o_orderstatus", "o_orderpriority").tally()


@query("SELECT o_orderstatus, CASE WHEN count(x) = count(*) THEN round(avg(x), 4) END AS strict, round(avg(x), 4) AS skipped, coalesce(round(sum(x), 2), 0) AS total FROM (SELECT o_orderstatus, CASE WHEN o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders) GROUP BY 1")
def mean_propagate_null(t):
    x = L.case_when(((c.o_orderpriority != "1-URGENT") | (c.o_orderstatus != "F"), c.o_totalprice))
    return t("orders").mutate(x=x).group_by("o_orderstatus").summarize(strict=r4(L.mean(c.x)), skipped=r4(L.mean(L.skipmissing(c.x))), total=L.scalar_(lambda a: F.round(a, 2))(L.sum_(L.skipmissing(c.x))))


@query("SELECT user_id, min_by(event_type, event_id) AS a, max_by(event_type, event_id) AS b, count(DISTINCT event_type) AS k FROM events GROUP BY 1")
def first_last_distinct(t):
    return t("events", "event_id").group_by("user_id").summarize(a=L.first(c.event_type), b=L.last(c.event_type), k=L.n_distinct(c.event_type))


@query("SELECT event_type, min_by(r, value) AS lo FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) GROUP BY 1")
def argmin_grouped(t):
    return t("events", "event_id").group_by("event_type").summarize(lo=L.argmin(c.value))


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", min({n})::DOUBLE AS min, quantile_cont({n}, 0.25)::DOUBLE AS q1, median({n})::DOUBLE AS median, round(avg({n}), 4) AS mean, quantile_cont({n}, 0.75)::DOUBLE AS q3, max({n})::DOUBLE AS max, count({n}) AS non_missing_values, count(*) - count({n}) AS missing_values, count(*) AS total_values, count(DISTINCT {n}) AS unique_values FROM supplier"
    for n in ("s_suppkey", "s_nationkey", "s_acctbal")
) + " UNION ALL SELECT 's_name', NULL, NULL, NULL, NULL, NULL, NULL, count(s_name), 0, count(*), count(DISTINCT s_name) FROM supplier"


@query(_SUMMARY)
def summary_supplier(t):
    return t("supplier").summary().mutate(mean=r4(c.mean))


# ---- windows -------------------------------------------------------------------------------

@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS k FROM orders")
def n_in_mutate(t):
    return t("orders").group_by("o_custkey").mutate(k=L.n()).ungroup().select("o_orderkey", "k")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 2 AS r FROM events")
def row_number_arith(t):
    return t("events", "event_id").group_by("user_id").mutate(r=L.row_number() * 2).ungroup().select("event_id", "r")


@query("SELECT event_id, CASE WHEN x IS NOT NULL THEN ntile(4) OVER (PARTITION BY x IS NULL ORDER BY x, event_id) END AS b FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS x FROM events)")
def ntile_null(t):
    return t("events", "event_id").mutate(x=L.case_when((c.event_type != "view", c.value))).mutate(b=L.ntile(c.x, 4)).select("event_id", "b")


@query("SELECT event_id, lag(event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lead(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events")
def lag_lead(t):
    return t("events", "event_id").group_by("user_id").mutate(a=L.lag(c.event_id), b=L.lead(c.event_id, 2, -1)).ungroup().select("event_id", "a", "b")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS s, (sum(event_id) OVER w)::BIGINT AS k, max(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumsum_grouped(t):
    return t("events", "event_id").group_by("user_id").mutate(s=r4(L.cumsum(c.value)), k=L.accumulate("+", c.event_id), m=L.accumulate(max, c.value)).ungroup().select("event_id", "s", "k", "m")


@query("SELECT event_id, round(product(1 + value / 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 0.00037, 2) AS p FROM events")
def cumprod_grouped(t):
    return t("events", "event_id").group_by("user_id").mutate(p=L.scalar_(lambda a: F.round(a + 0.00037, 2))(L.cumprod(c.value / 1000 + 1))).ungroup().select("event_id", "p")


# ---- scalar functions ------------------------------------------------------------------------

@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS k FROM orders")
def if_else3(t):
    return t("orders").transmute("o_orderkey", k=L.if_else(c.o_totalprice > 150000, "high", "low"))


@query("SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'none' WHEN nullif(o_orderstatus, 'P') = 'F' THEN 'f' ELSE 'o' END AS k FROM orders")
def if_else4(t):
    return t("orders").transmute("o_orderkey", k=L.if_else(L.missing_if(c.o_orderstatus, "P") == "F", "f", "o", "none"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 100000 THEN 2 END AS k FROM orders")
def case_when(t):
    return t("orders").transmute("o_orderkey", k=L.case_when((c.o_totalprice > 200000, 3), (c.o_totalprice > 100000, 2)))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s, nullif(o_orderstatus, 'F') AS m FROM orders")
def missing_if_replace(t):
    return t("orders").transmute("o_orderkey", s=L.replace_missing(L.missing_if(c.o_orderstatus, "P"), "none"), m=L.missing_if(c.o_orderstatus, "F"))


@query("SELECT c_custkey, floor(c_acctbal)::BIGINT AS a, floor(-c_acctbal / 3)::BIGINT AS b, try_cast(c_mktsegment AS DOUBLE) AS d, c_custkey::VARCHAR AS s FROM customer")
def conversions(t):
    return t("customer").transmute("c_custkey", a=L.as_integer(L.as_string(c.c_acctbal)), b=L.as_integer(-c.c_acctbal / 3), d=L.as_float(c.c_mktsegment), s=L.as_string(c.c_custkey))


@query("SELECT p_partkey, upper(p_name) AS u, length(p_brand) AS l, p_size % 7 AS m, p_size // 7 AS q, round_even(p_retailprice, 0) AS r, abs(-p_size) AS a, pow(p_size, 2) AS w FROM part")
def scalars(t):
    return t("part").transmute("p_partkey", u=L.upper(c.p_name), l=L.nchar(c.p_brand), m=c.p_size % 7, q=c.p_size // 7, r=L.round_(c.p_retailprice, 0), a=abs(-c.p_size), w=c.p_size**2)


# ---- joins and binding ---------------------------------------------------------------------------

_O = "SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_totalprice > 100000"
_LI = "SELECT l_orderkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_tax > 0.02 GROUP BY 1"


def _sides(t):
    left = t("orders").filter(c.o_totalprice > 100000).select(k="o_orderkey", o_custkey="o_custkey")
    right = t("lineitem").filter(c.l_tax > 0.02).group_by(k=c.l_orderkey).summarize(q=L.sum_(c.l_quantity))
    return left, right


def _add_join(name: str, sql: str) -> None:
    def run(t):
        left, right = _sides(t)
        return getattr(left, name)(right, "k")

    run.__name__ = f"join_{name.split('_')[0]}"
    query(sql)(run)


for _how in ("left", "right", "inner", "full"):
    _add_join(f"{_how}_join", f"SELECT k, o_custkey, q FROM ({_O}) {_how} JOIN ({_LI}) USING (k)")
_add_join("semi_join", f"SELECT * FROM ({_O}) SEMI JOIN ({_LI}) USING (k)")
_add_join("anti_join", f"SELECT * FROM ({_O}) ANTI JOIN ({_LI}) USING (k)")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_renamed(t):
    return t("customer").left_join(t("nation"), {"c_nationkey": "n_nationkey"})


@query("SELECT r_regionkey AS key, r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def join_natural(t):
    return t("region").rename(key="r_regionkey").inner_join(t("nation").select(n_name="n_name", key="n_regionkey"))


@query("SELECT r_name AS name, 1::BIGINT AS source, NULL::INT AS key FROM region UNION ALL SELECT n_name, 2, n_nationkey FROM nation")
def bind_rows_id(t):
    return t("region").select(name="r_name").bind_rows(t("nation").select(name="n_name", key="n_nationkey"), id="source")


@query("SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_nationkey < 5) USING (i)")
def bind_cols(t):
    return t("region", "r_regionkey").select("r_name").bind_cols(t("nation", "n_nationkey").filter(c.n_nationkey < 5).select("n_name"))


# ---- reshaping and nesting --------------------------------------------------------------------------

@query("SELECT o_orderpriority, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN n END), 0) AS \"F\", coalesce(max(CASE WHEN o_orderstatus = 'O' THEN n END), 0) AS \"O\", coalesce(max(CASE WHEN o_orderstatus = 'P' THEN n END), 0) AS \"P\" FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_wider_fill(t):
    return t("orders").count("o_orderpriority", "o_orderstatus").pivot_wider("o_orderstatus", "n", values_fill=0)


@query("SELECT o_orderpriority, " + ", ".join(f"max(CASE WHEN o_orderstatus = '{s}' THEN {v} END) AS \"{s}_{v}\"" for v in ("n", "m") for s in "FOP") + " FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_wider_multi(t):
    return t("orders").group_by("o_orderpriority", "o_orderstatus").summarize(n=L.n(), m=L.maximum(c.o_totalprice)).ungroup().pivot_wider("o_orderstatus", ["n", "m"])


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def pivot_longer_num(t):
    return t("part").select("p_partkey", "p_size", "p_retailprice").pivot_longer(-c.p_partkey)


@query("SELECT s_suppkey, 's_name' AS k, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::VARCHAR FROM supplier")
def pivot_longer_mixed(t):
    return t("supplier").select("s_suppkey", "s_name", "s_nationkey").pivot_longer("s_name:s_nationkey", names_to="k", values_to="v")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS b FROM orders WHERE strpos(o_orderpriority, '-') > 0")
def separate_merge(t):
    return t("orders").filter(L.str_contains(c.o_orderpriority, "-")).select("o_orderkey", "o_orderpriority").separate("o_orderpriority", ["a", "b"], "-")


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS a FROM part")
def separate_drop(t):
    return t("part").select("p_partkey", "p_name").separate("p_name", ["a"], " ", extra="drop")


@query("SELECT o_orderkey, regexp_split_to_array(o_orderpriority, '[- ]+')[1] AS a, regexp_split_to_array(o_orderpriority, '[- ]+')[2] AS b FROM orders")
def separate_regex(t):
    return t("orders").select("o_orderkey", "o_orderpriority").separate("o_orderpriority", ["a", "b"], re.compile("[- ]+"), extra="drop")


@query("SELECT n_regionkey, concat_ws('-', n_nationkey::VARCHAR, nullif(n_name, 'FRANCE')) AS u FROM nation")
def unite_skipnull(t):
    return t("nation").mutate(n_name=L.missing_if(c.n_name, "FRANCE")).unite("u", ["n_nationkey", "n_name"], sep="-")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part")
def separate_rows(t):
    return t("part").select("p_partkey", "p_name").separate_rows("p_name", sep=" ")


@query("SELECT event_type, event_id, value FROM events")
def nest_unnest_roundtrip(t):
    return t("events", "event_id").select("event_type", "event_id", "value").nest(data=["event_id", "value"]).unnest_longer("data").mutate(event_id=L.field(c.data, "event_id"), value=L.field(c.data, "value")).select("event_type", "event_id", "value")


@query("SELECT vec_id, unnest(embedding) AS embedding, unnest(range(1, len(embedding) + 1)) AS embedding_id FROM embeddings")
def unnest_longer_index(t):
    return t("embeddings").select("vec_id", "embedding").unnest_longer("embedding", indices_include=True)


@query("SELECT vec_id, " + ", ".join(f"embedding[{i}] AS embedding_{i}" for i in range(1, 65)) + " FROM embeddings")
def unnest_wider_array(t):
    return t("embeddings").select("vec_id", "embedding").unnest_wider("embedding")


@query("SELECT event_id, (props->>'k')::BIGINT AS props_k FROM events")
def unnest_wider_json(t):
    return t("events").transmute("event_id", props=L.scalar_(lambda a: F.from_json(a, "k bigint"))(c.props)).unnest_wider("props")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def unnest_wider_map(t):
    return t("events").transmute("event_id", props=L.scalar_(lambda a: F.from_json(a, "map<string,bigint>"))(c.props)).unnest_wider("props", names_sep=None)


# ---- the six benchmark shapes ---------------------------------------------------------------------------

@query("SELECT * FROM lineitem WHERE l_quantity > 20 AND l_discount > 0.04")
def bench_filter(t):
    return t("lineitem").filter(c.l_quantity > 20, c.l_discount > 0.04)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def bench_count(t):
    return t("lineitem").count("l_returnflag")


@query("SELECT l_orderkey, l_extendedprice * l_discount AS cut FROM lineitem")
def bench_product(t):
    return t("lineitem").transmute("l_orderkey", cut=c.l_extendedprice * c.l_discount)


@query("SELECT l_orderkey, l_quantity * 2 AS a, l_extendedprice * (1 - l_discount) AS b, l_tax + l_discount AS d, l_quantity - 1 AS e, l_extendedprice * l_tax AS f, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS g FROM lineitem")
def bench_six(t):
    return t("lineitem").transmute("l_orderkey", a=c.l_quantity * 2, b=c.l_extendedprice * (1 - c.l_discount), d=c.l_tax + c.l_discount, e=c.l_quantity - 1, f=c.l_extendedprice * c.l_tax, g=L.if_else(c.l_quantity > 25, "many", "few"))


@query("SELECT l_orderkey, l_returnflag, round(m, 4) AS m, round(l_quantity - m, 4) AS d FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)")
def bench_grouped(t):
    return t("lineitem").group_by("l_returnflag").mutate(m=L.mean(c.l_quantity)).mutate(d=r4(c.l_quantity - c.m), m=r4(c.m)).ungroup().select("l_orderkey", "l_returnflag", "m", "d")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def bench_select(t):
    return t("lineitem").select("l_quantity:l_tax")


BENCH = ("bench_filter", "bench_count", "bench_product", "bench_six", "bench_grouped", "bench_select")


# ---- order, sampling, conversions, user functions: what the queries above leave out --------------

@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
def arrange_order(t):
    return t("orders").arrange(L.desc("o_totalprice"), "o_orderkey").mutate(r=L.row_number()).select("o_orderkey", "r")


@query("SELECT o_orderpriority, n, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def count_sort_order(t):
    counted = t("orders").count("o_orderpriority", sort=True)
    # the order that count() set, with the key for ties
    return counted.arrange(*[L.desc(n) if d else n for n, d in counted.order], "o_orderpriority").mutate(r=L.row_number())


@query("SELECT 50 AS n, 50 AS known, 50 AS distinct_rows")
def slice_sample_members(t):
    sample = t("orders").slice_sample(n=50).select("o_orderkey")
    sample = sample.left_join(t("orders").transmute("o_orderkey", there=c.o_orderkey), by="o_orderkey")
    return sample.summarize(n=L.n(), known=L.sum_(~L.ismissing(c.there)), distinct_rows=L.n_distinct(c.o_orderkey))


@query("SELECT o_orderstatus, count(*) // 2 AS n FROM orders GROUP BY 1")
def slice_sample_replace(t):
    return t("orders").group_by("o_orderstatus").slice_sample(prop=0.5, replace=True).count("o_orderstatus")


@query("SELECT o_orderkey, o_orderkey + 1234567890123456789 AS a, o_orderkey + 1234567890123456789 AS b, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS f, floor(o_totalprice)::BIGINT AS p, floor(-o_totalprice)::BIGINT AS m FROM orders")
def as_integer_bigint(t):
    big = c.o_orderkey + L.scalar_(lambda: F.lit(1234567890123456789))()
    return t("orders").mutate(a=L.as_integer(big), b=L.as_integer(L.as_string(big)), f=L.as_integer(c.o_orderstatus == "F"), p=L.as_integer(c.o_totalprice), m=L.as_integer(-c.o_totalprice)).select("o_orderkey", "a", "b", "f", "p", "m")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS f, o_custkey::DOUBLE AS k, NULL::DOUBLE AS s FROM orders")
def as_float_bool(t):
    return t("orders").mutate(f=L.as_float(c.o_orderstatus == "F"), k=L.as_float(c.o_custkey), s=L.as_float(c.o_orderpriority)).select("o_orderkey", "f", "k", "s")


@query("SELECT l_returnflag, median(d) AS mad FROM (SELECT l_returnflag, abs(l_quantity - median(l_quantity) OVER (PARTITION BY l_returnflag)) AS d FROM lineitem) GROUP BY 1")
def mad_grouped(t):
    return t("lineitem").group_by("l_returnflag").summarize(mad=L.mad(c.l_quantity))


@query("SELECT event_type, max(r) FILTER (value = m AND r = f) AS hi FROM (SELECT *, min(CASE WHEN value = m THEN r END) OVER (PARTITION BY event_type) AS f FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, max(value) OVER (PARTITION BY event_type) AS m FROM events)) GROUP BY 1")
def argmax_grouped(t):
    return t("events", "event_id").group_by("event_type").summarize(hi=L.argmax(c.value))


@query("SELECT o_orderstatus, count(*) AS k, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def proprow_length(t):
    return t("orders").group_by("o_orderstatus").summarize(k=L.length(c.o_orderkey), share=L.scalar_(lambda a: F.round(a, 6))(L.proprow()))


@query("SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS u FROM orders GROUP BY 1")
def unique_values(t):
    return t("orders").group_by("o_orderstatus").summarize(u=L.unique(c.o_orderpriority)).mutate(u=L.scalar_(F.sort_array)(c.u))


@query("SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def user_aggregate(t):
    L.user_agg(lambda s: float(s.max() - s.min()), name="spread_of")
    return t("orders").group_by("o_orderstatus").summarize(spread=parse("spread_of(o_totalprice)")).mutate(spread=L.scalar_(lambda a: F.round(a, 2))(c.spread))


@query("SELECT s_suppkey, s_suppkey * 3 + 1 AS a, s_suppkey * 5 AS b FROM supplier")
def user_functions(t):
    return t("supplier").mutate(a=L.user_fn(lambda k: k * 3 + 1, "bigint")(c.s_suppkey), b=L.vectorized_fn(lambda s: s * 5, "bigint")(c.s_suppkey)).select("s_suppkey", "a", "b")


@query("SELECT n_name, n_regionkey FROM nation")
def select_not_positions(t):
    return t("nation").select("n_nationkey", "n_name", "n_regionkey").select(-1)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_not_tuple(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select("!(o_custkey, o_orderstatus)")


@query("SELECT o_custkey, o_totalprice FROM orders")
def select_not_third(t):
    return t("orders").select("o_custkey", "o_totalprice", "o_orderkey").select("!3")


@query("SELECT l_quantity, l_tax FROM lineitem")
def select_where_data(t):
    few = t("lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    return few.select(S.where(lambda x: L.maximum(x) <= 50))


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 19")
def filter_in_span(t):
    return t("orders").filter(L.in_(c.o_custkey, range(10, 20))).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice * 3 AS x, round(pi() * o_custkey, 6) AS y FROM orders WHERE o_totalprice > 100000")
def interpolation_constants(t):
    return t("orders").filter(parse("o_totalprice > least_price", least_price=100000)).mutate(x=parse("o_totalprice * k", k=3), y=L.scalar_(lambda a: F.round(a, 6))(L.pi * c.o_custkey)).select("o_orderkey", "x", "y")


@query('SELECT o_orderkey AS "order key", o_totalprice + 1 AS "price and one" FROM orders')
def names_with_spaces(t):
    return t("orders").rename(**{"order key": "o_orderkey"}).mutate(**{"price and one": c.o_totalprice + 1}).select("order key", "price and one")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS norm FROM embeddings")
def comprehension(t):
    return t("embeddings").mutate(norm=L.scalar_(lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4))(L.transform(c.embedding, lambda x: x.cast("double") * x))).select("vec_id", "norm")


@query("SELECT o_orderkey, x IS NULL AS gone, coalesce(x, -1) AS y FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS x FROM orders)")
def ismissing_coalesce(t):
    return t("orders").mutate(x=L.missing_if(c.o_custkey, 7)).mutate(gone=L.ismissing(c.x), y=L.coalesce(c.x, -1)).select("o_orderkey", "gone", "y")


@query("SELECT n_nationkey, n_name || '-' || n_regionkey AS s, trim(n_name) AS t, reverse(n_name) AS r, substring(n_name, 2, 3) AS m, lpad(n_name, 12, '.') AS p, replace(n_name, 'A', 'b') AS q FROM nation")
def string_functions(t):
    return t("nation").mutate(s=L.sprintf("%s-%d", c.n_name, c.n_regionkey), t=L.trim(c.n_name), r=L.reverse(c.n_name), m=L.substring(c.n_name, 2, 3), p=L.pad(c.n_name, 12, "."), q=L.replace(c.n_name, "A", "b")).select("n_nationkey", "s", "t", "r", "m", "p", "q")


@query("SELECT s_suppkey, round(sqrt(s_suppkey), 6) AS a, round(exp(s_suppkey / 1000.0), 6) AS b, floor(s_acctbal)::BIGINT AS d, ceil(s_acctbal)::BIGINT AS e, round(ln(s_suppkey), 6) AS f, round(log2(s_suppkey), 6) AS g, sign(s_acctbal)::DOUBLE AS h FROM supplier WHERE s_suppkey > 0")
def math_functions(t):
    r6 = L.scalar_(lambda a: F.round(a, 6))
    return t("supplier").filter(c.s_suppkey > 0).mutate(a=r6(L.sqrt(c.s_suppkey)), b=r6(L.exp(c.s_suppkey / 1000.0)), d=L.floor(c.s_acctbal), e=L.ceil(c.s_acctbal), f=r6(L.log(c.s_suppkey)), g=r6(L.log2(c.s_suppkey)), h=L.sign(c.s_acctbal)).select("s_suppkey", "a", "b", "d", "e", "f", "g", "h")


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice_mean_skipmissing FROM orders GROUP BY 1")
def across_composed(t):
    return t("orders").group_by("o_orderstatus").summarize(L.across("o_totalprice", L.compose(L.mean, L.skipmissing))).mutate(o_totalprice_mean_skipmissing=r4(c.o_totalprice_mean_skipmissing))


@query("SELECT count(*) AS n FROM orders")
def rand_range(t):
    return t("orders").mutate(u=L.rand(1)).filter(c.u >= 0, c.u < 1).summarize(n=L.n())


@query("SELECT a.v, b.w FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k, n_regionkey AS v FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k, r_regionkey AS w FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_na_matches(t):
    left = t("nation").transmute(k=L.missing_if(c.n_regionkey, 2), v=c.n_regionkey).distinct()
    return left.inner_join(t("region").transmute(k=L.missing_if(c.r_regionkey, 2), w=c.r_regionkey), by="k", na_matches=True).select("v", "w")


@query("SELECT n.n_nationkey, n.n_name AS name, r.r_name AS name_right FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_suffix(t):
    left = t("nation").transmute(n_nationkey=c.n_nationkey, name=c.n_name, key=c.n_regionkey)
    return left.inner_join(t("region").transmute(key=c.r_regionkey, name=c.r_name), by="key", suffix=("", "_right")).select("n_nationkey", "name", "name_right")


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS x FROM lineitem")
def covariance(t):
    return t("lineitem").summarize(x=r4(L.cov(c.l_quantity, c.l_extendedprice)))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def pipe_aside(t):
    seen = []
    return t("nation").aside(lambda f: seen.append(f.ncol())).pipe(lambda f, key: f.count(key), "n_regionkey")
