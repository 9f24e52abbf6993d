"""Set operations; INTERSECT binds tighter than UNION and EXCEPT."""

from __future__ import annotations

from .registry import query, sql

sql("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("setop_precedence", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT s_nationkey FROM supplier")
sql("setop_chain", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region UNION SELECT 100")
sql("setop_null", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 1) FROM region")
sql("setop_order_limit", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer ORDER BY k DESC LIMIT 9 OFFSET 2")
sql("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def union_frames(t):
    rich = t.customer.filter("c_acctbal > 9000").selectExpr("c_nationkey AS k")
    return rich.union(t.supplier.filter("s_acctbal > 9000").selectExpr("s_nationkey AS k")).distinct()
