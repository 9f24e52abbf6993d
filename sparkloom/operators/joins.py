"""Joins. Equi-joins shuffle on their keys or broadcast a side that Catalyst's size check allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, sql

sql("join_inner", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey")
sql("join_left_unmatched", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
sql("join_right", "SELECT o.o_orderkey, c.c_name FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
sql("join_full", "SELECT a.r_name AS x, b.n_name AS y FROM region a FULL OUTER JOIN nation b ON a.r_regionkey = b.n_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
sql("join_theta", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_multi", "SELECT r_name, round(sum(o_totalprice), 2) AS t FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name")
sql("join_using", "SELECT k, a.n_name AS x, b.s AS y FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY s_nationkey) b USING (k)")
sql("join_natural", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS y FROM supplier GROUP BY s_nationkey) b")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 48")
def join_hash(t):
    """Shuffled hash join: the build side is hashed per partition."""
    items = t.lineitem.filter("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_partkey")
    return items.join(t.part.select("p_partkey", "p_name").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
def join_merge(t):
    orders = t.orders.filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    return orders.join(t.customer.select("c_custkey", "c_mktsegment").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_lookup(t):
    """A side of a few rows; Catalyst broadcasts it by its size."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) a JOIN (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation) b ON a.v IS NOT DISTINCT FROM b.v AND a.k < b.k")
def join_null_safe(t):
    side = t.nation.select(F.col("n_nationkey").alias("k"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("v"))
    a, b = side.alias("a"), side.alias("b")
    return a.join(b, F.col("a.v").eqNullSafe(F.col("b.v")) & (F.col("a.k") < F.col("b.k"))).select(F.col("a.k").alias("x"), F.col("b.k").alias("y"))


def band_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, width: float, equal: list[str] | None = None) -> DataFrame:
    """Pairs with |left_key - right_key| <= width, as an equi-join.

    Keys fall into bins of the width; a left row looks into its own bin and both
    neighbours. The bins (with the columns of ``equal``) are the join's keys, so the
    work is spread by them and no cross join arises.
    """
    a = left.withColumn("_left", left_key).withColumn("_bin", F.explode(F.sequence(F.floor(left_key / width).cast("long") - 1, F.floor(left_key / width).cast("long") + 1)))
    b = right.withColumn("_right", right_key).withColumn("_bin", F.floor(right_key / width).cast("long"))
    return a.join(b, ["_bin", *(equal or [])]).filter(F.abs(F.col("_left") - F.col("_right")) <= width).drop("_bin", "_left", "_right")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch(b.ts) - epoch(a.ts)) <= 3600 WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'")
def join_band(t):
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    a, b = (bought.select("user_id", F.col("event_id").alias(x), F.col("us").alias(f"us_{x}")) for x in "ab")
    return band_join(a, b, F.col("us_a"), F.col("us_b"), 3.6e9, ["user_id"]).filter("a < b").select("a", "b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of the same key that is not later.

    Both sides are put under one another and carried forward by a window per key: one
    shuffle, and no pairs. Right rows of the same time count in the order of their values.
    """
    payload = F.struct(*values)
    a = left.select("*", F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_right"))
    b = right.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), payload.alias("_right"))
    order = Window.partitionBy(*by).orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    return both.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


@query("SELECT p.event_id, (SELECT max_by(v.event_id, v.ts) FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS view_id FROM events p WHERE p.event_type = 'purchase'")
def join_asof(t):
    bought = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("view_id"))
    return asof_join(bought, seen, ["user_id"], "ts", "seen_at", ["view_id"]).select("event_id", "view_id")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """An inner equi-join whose keys are spread over ``salts`` partitions each, for keys that hold much of ``left``.

    A row's salt is its place in its task, so equal rows are spread as well; a task that
    runs again over the same input gives the same salts. Both sides are shuffled whatever
    their size: Catalyst doesn't count the copies of ``right``, and would broadcast them all.
    """
    a = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, "_salt"]).drop("_salt")


@query("SELECT c_nationkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def join_salted(t):
    orders = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    found = salted_join(orders, t.customer.select(F.col("c_custkey").alias("k"), "c_nationkey"), "k")
    return found.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
