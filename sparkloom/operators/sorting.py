"""Sort, limit, offset, top-k and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, sql

sql("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 7")
sql("offset_alone", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
sql("sort_nulls", "SELECT p_partkey, nullif(p_size % 5, 0) AS v FROM part ORDER BY v ASC, p_partkey DESC LIMIT 12", "SELECT p_partkey, nullif(p_size % 5, 0) AS v FROM part ORDER BY v ASC NULLS FIRST, p_partkey DESC LIMIT 12")
sql("sort_nulls_last", "SELECT p_partkey, nullif(p_size % 5, 0) AS v FROM part ORDER BY v DESC, p_partkey LIMIT 12", "SELECT p_partkey, nullif(p_size % 5, 0) AS v FROM part ORDER BY v DESC NULLS LAST, p_partkey LIMIT 12")
sql("sort_expression", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal % 100, c_custkey LIMIT 9")
sql("sort_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 6")
sql("limit_zero", "SELECT n_name FROM nation LIMIT 0")
sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("distinct_null", "SELECT DISTINCT nullif(n_regionkey, 1) AS k FROM nation")
sql("distinct_float", "SELECT DISTINCT l_tax + 0.0 AS x FROM lineitem")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def top_k(t):
    """A limit on a sort keeps k rows per task before they meet."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(25)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def sort_full(t):
    """A total order: range partitions, each sorted, with spill."""
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_custkey", F.desc("o_totalprice"), "o_orderkey")
