"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, sql

_U = "PARTITION BY user_id ORDER BY ts, event_id"

sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders")
sql("win_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice / 1000 AS INT)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice / 1000 AS INT)) AS BIGINT) AS dr FROM orders", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(trunc(o_totalprice / 1000) AS INT)) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY CAST(trunc(o_totalprice / 1000) AS INT)) AS BIGINT) AS dr FROM orders")
sql("win_laglead", f"SELECT event_id, lag(value, 1, -1.0D) OVER ({_U}) AS l, lead(value) OVER ({_U}) AS n, lag(event_id, 2) OVER ({_U}) AS l2 FROM events", f"SELECT event_id, lag(value, 1, -1.0::DOUBLE) OVER ({_U}) AS l, lead(value) OVER ({_U}) AS n, lag(event_id, 2) OVER ({_U}) AS l2 FROM events")
sql("win_values", f"SELECT event_id, first_value(event_id) OVER ({_U}) AS f, last_value(event_id) OVER ({_U} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER ({_U} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM events")
sql("win_aggregates", f"SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, round(sum(value) OVER ({_U}), 4) AS s, round(avg(value) OVER (PARTITION BY event_type), 4) AS a, min(value) OVER ({_U}) AS mn, max(value) OVER (PARTITION BY user_id) AS mx FROM events")
sql("win_rows_frame", f"SELECT event_id, round(sum(value) OVER ({_U} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER ({_U} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c, round(sum(value) OVER ({_U} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS r FROM events")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
sql("win_distribution", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS q, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey), 6) AS p, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey), 6) AS d FROM customer")
sql("win_over_groups", "SELECT o_orderpriority, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS rk FROM orders GROUP BY o_orderpriority")
sql("win_then_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS BIGINT) AS rn FROM nation ORDER BY rn DESC LIMIT 5")


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t WHERE rn <= 3")
def win_top_per_group(t):
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(best).cast("long").alias("rn")).filter("rn <= 3")


@query("SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events) t")
def win_sessions(t):
    """Sessions of a user's events, parted by 12 hours of silence."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    fresh = F.when(before.isNull() | (F.col("ts") - before > F.expr("INTERVAL '12' HOUR")), 1).otherwise(0)
    return t.events.withColumn("fresh", fresh).select("event_id", F.sum("fresh").over(order).cast("long").alias("session"))
