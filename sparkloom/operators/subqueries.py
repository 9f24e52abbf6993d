"""Subqueries: Catalyst turns them into joins."""

from __future__ import annotations

from ..plans.dialect import translate
from .registry import sql

sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("scalar_subquery_empty", "SELECT n_nationkey, (SELECT max(r_regionkey) FROM region WHERE r_regionkey < 0) AS m FROM nation")
sql("scalar_subquery_first", "SELECT n_nationkey, (SELECT r_name FROM region ORDER BY r_name LIMIT 1) AS m FROM nation")
sql("correlated_scalar", "SELECT c.c_custkey, (SELECT round(max(o.o_totalprice), 2) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c")
sql("correlated_count", "SELECT s.s_suppkey, (SELECT count(*) FROM customer c WHERE c.c_nationkey = s.s_nationkey) AS n FROM supplier s")
sql("exists_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("not_exists_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 350000)")
sql("in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
_NOT_IN = "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"
_NOT_IN_NULL = "SELECT p_partkey FROM part WHERE p_size NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)"
sql("not_in_subquery", translate(_NOT_IN), _NOT_IN)  # an anti join on keys, not a broadcast of the subquery
sql("not_in_subquery_null", translate(_NOT_IN_NULL), _NOT_IN_NULL)
sql("in_compound_subquery", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT 4)")
sql("correlated_exists_theta", "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice / 2)")
sql("subquery_in_having", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= (SELECT avg(c) FROM (SELECT count(*) AS c FROM nation GROUP BY n_regionkey) t)")
