"""Projection, filters and three-valued predicates. The tables hold no NULLs, so NULLIF makes some."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import case_of, glob
from .registry import query, sql

_PART = "SELECT p_partkey, nullif(p_size % 5, 0) AS v FROM part"


def _with_nulls(t):
    return t.part.select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("v"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'")
def filter_conjuncts(t):
    return t.orders.filter("o_totalprice > 200000").filter("o_orderstatus = 'O'").filter("o_orderpriority <> '1-URGENT'").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_brand IN ('Brand#11', 'Brand#12')")
def filter_between_in(t):
    return t.part.filter(F.col("p_size").between(5, 10) & F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey")


sql("filter_not_between", f"SELECT p_partkey FROM ({_PART}) t WHERE v NOT BETWEEN 2 AND 3")
sql("filter_not_in", f"SELECT p_partkey FROM ({_PART}) t WHERE v NOT IN (1, 2)")
sql("filter_in_null", f"SELECT p_partkey, v IN (1, NULL) AS r FROM ({_PART}) t")
sql("filter_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%01%'")
sql("filter_not_like", "SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1_'")
sql("logic_three_valued", f"SELECT p_partkey, v > 2 AND v < 4 AS a, v > 2 OR v IS NULL AS o, NOT (v = 1) AS n FROM ({_PART}) t")
sql("compare_all", f"SELECT p_partkey, v = 2 AS e, v != 2 AS ne, v < 2 AS l, v <= 2 AS le, v > 2 AS g, v >= 2 AS ge FROM ({_PART}) t")
sql("truth_table", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, a = 1 AND b = 1 AS x, a = 1 OR b = 1 AS o, NOT (a = 1) AS n FROM (VALUES (1, 1), (1, 0), (1, NULL), (0, 0), (0, NULL), (NULL, NULL)) AS t(a, b)")
sql("in_truth", "SELECT NULL IN (1) AS a, 1 IN (1, NULL) AS b, 2 IN (1, NULL) AS c, 2 NOT IN (1, NULL) AS d, 2 NOT IN (1, 3) AS e")


@query(f"SELECT p_partkey FROM ({_PART}) t WHERE v IS NULL")
def filter_is_null(t):
    return _with_nulls(t).filter("v IS NULL").select("p_partkey")


@query(f"SELECT p_partkey FROM ({_PART}) t WHERE v IS NOT NULL")
def filter_is_not_null(t):
    return _with_nulls(t).filter("v IS NOT NULL").select("p_partkey")


@query(f"SELECT p_partkey, v IS NOT DISTINCT FROM NULL AS n, v IS NOT DISTINCT FROM 3 AS three FROM ({_PART}) t")
def compare_null_safe(t):
    v = F.col("v")
    return _with_nulls(t).select("p_partkey", v.eqNullSafe(None).alias("n"), v.eqNullSafe(3).alias("three"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type GLOB '[A-M]*' AND p_brand GLOB 'Brand#?2'")
def filter_glob(t):
    return t.part.filter(glob("[A-M]*", F.col("p_type")) & glob("Brand#?2", F.col("p_brand"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'hi' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'lo' END AS b FROM orders")
def case_searched(t):
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(price > 200000, "hi").when(price > 100000, "mid").otherwise("lo").alias("b"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s FROM orders")
def case_simple(t):
    return t.orders.select("o_orderkey", case_of(F.col("o_orderstatus"), {"O": "open", "F": "done"}, "other").alias("s"))


@query("SELECT p_partkey FROM part WHERE p_size % 2 <> 0")
def filter_truthy_number(t):
    return t.part.filter((F.col("p_size") % 2) != 0).select("p_partkey")


@query("SELECT c_custkey AS id, c_name || '/' || c_mktsegment AS label, round(c_acctbal * 1.1, 4) AS more FROM customer")
def project_expressions(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("/"), "c_mktsegment").alias("label"), F.round(F.col("c_acctbal") * 1.1, 4).alias("more"))
