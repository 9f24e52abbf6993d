"""Aggregation: partial sums before the shuffle, final ones after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, sql

sql("agg_scalar", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_discount), 4) AS a, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem")
sql("agg_group", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority")
sql("agg_group_having", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag HAVING count(*) > 100")
sql("agg_having_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sd, round(avg(DISTINCT l_quantity), 4) AS ad, min(DISTINCT l_quantity) AS mn, max(DISTINCT l_quantity) AS mx FROM lineitem GROUP BY l_returnflag")
sql("agg_group_by_expression", "SELECT CAST(p_size % 10 AS BIGINT) AS k, count(*) AS n FROM part GROUP BY p_size % 10")
sql("agg_group_float", "SELECT l_discount + 0.0 AS d, count(*) AS n FROM lineitem GROUP BY l_discount")
sql("agg_null_group", "SELECT nullif(n_regionkey, 1) AS k, count(*) AS n FROM nation GROUP BY nullif(n_regionkey, 1)")
sql("agg_count_null", "SELECT count(*) AS n, count(nullif(p_size % 5, 0)) AS v, CAST(sum(nullif(p_size % 5, 0)) AS BIGINT) AS s, round(avg(nullif(p_size % 5, 0)), 4) AS a FROM part")
sql("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem WHERE l_quantity < 0")
sql("agg_empty_grouped", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
sql("agg_computed", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*) + 1, 4) AS m, CAST(max(o_custkey) - min(o_custkey) AS BIGINT) AS w FROM orders GROUP BY o_orderstatus")
sql("agg_filter", "SELECT n_regionkey, count(*) FILTER (WHERE n_nationkey > 10) AS big, count(*) AS n FROM nation GROUP BY n_regionkey")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_retailprice), 4) AS vp, round(median(p_retailprice), 4) AS md FROM part GROUP BY p_brand")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS g, string_agg(DISTINCT substr(n_name, 1, 1), ';' ORDER BY substr(n_name, 1, 1)) AS d FROM nation GROUP BY n_regionkey")
def group_concat(t):
    t.nation.createOrReplaceTempView("nation")
    return t._spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS g, listagg(DISTINCT substr(n_name, 1, 1), ';') WITHIN GROUP (ORDER BY substr(n_name, 1, 1)) AS d FROM nation GROUP BY n_regionkey")


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def agg_high_cardinality(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.countDistinct("l_orderkey").alias("orders"))


@query()
def agg_approximate(t):
    """HyperLogLog and quantile sketches: estimates, so there is no SQL twin."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))
