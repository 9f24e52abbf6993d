"""Scans, VALUES, views, derived tables and common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, sql


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(t):
    ship = F.col("l_shipdate")
    chosen = t.lineitem.filter((ship >= F.lit("1995-01-01").cast("timestamp_ntz")) & (ship < F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return chosen.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("SELECT * FROM region")
def scan_full(t):
    return t.region


@query("SELECT n_nationkey, n_name FROM nation")
def scan_columns(t):
    return t.nation.select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def scan_equality(t):
    return t.orders.filter("o_custkey = 42").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 220")
def scan_range(t):
    return t.orders.filter((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 220)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'sma%' AND p_size > 10")
def scan_prefix(t):
    return t.part.filter(F.col("p_name").startswith("sma") & (F.col("p_size") > 10)).select("p_partkey", "p_name")


sql("values_row", "SELECT CAST(1 + 2 AS BIGINT) AS a, 'x' || 'y' AS b, CAST(NULL AS BIGINT) AS c")
sql("values_rows", "SELECT CAST(k AS BIGINT) AS k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
sql("derived", "SELECT CAST(b AS BIGINT) AS b, count(*) AS n FROM (SELECT p_size % 7 AS b FROM part) t GROUP BY b")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM big WHERE t > 500000")
sql("cte_columns", "WITH a(k, n) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey), b AS (SELECT k, n FROM a WHERE n > 1) SELECT r_name, n FROM b JOIN region ON k = r_regionkey")
sql("cte_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(n AS BIGINT) AS n, CAST(n * n AS BIGINT) AS sq FROM r")


@query("SELECT c_custkey, round(c_acctbal, 2) AS bal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def view_composed(t):
    """A view keeps the columns and filters put on top of it."""
    t.customer.filter("c_acctbal > 0").createOrReplaceTempView("solvent_customers")
    return t._spark.sql("SELECT c_custkey, round(c_acctbal, 2) AS bal FROM solvent_customers WHERE c_mktsegment = 'BUILDING'")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 30 AND p_brand = 'Brand#12'")
def parameters(t):
    """Positional parameters of a statement."""
    t.part.createOrReplaceTempView("part")
    return t._spark.sql("SELECT p_partkey, p_size FROM part WHERE p_size > ? AND p_brand = ?", args=[30, "Brand#12"])
