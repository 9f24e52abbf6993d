"""Changes and constraints as queries: the version of a table after a statement, and what breaks a constraint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import changes
from ..plans.catalog import Column, ForeignKey, Table
from .registry import query


def _more_regions(t):
    return t._spark.createDataFrame([(3, "CHANGED"), (7, "NEW"), (8, "NEWER")], "r_regionkey int, r_name string")


_MORE = "(VALUES (3, 'CHANGED'), (7, 'NEW'), (8, 'NEWER')) AS m(r_regionkey, r_name)"


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'ATLANTIS' UNION ALL SELECT 10, 'none'")
def insert_values(t):
    table = Table("region", [Column("r_regionkey", "int"), Column("r_name", "string", default="'none'")], rows=t.region)
    full = table.completed(t._spark.createDataFrame([(9, "ATLANTIS")], "a int, b string"), ["r_regionkey", "r_name"])
    short = table.completed(t._spark.createDataFrame([(10,)], "a int"), ["r_regionkey"])
    return changes.insert(changes.insert(t.region, full), short)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def insert_select(t):
    return changes.insert(t.region, t.nation.filter("n_regionkey = 1").selectExpr("n_nationkey + 100 AS r_regionkey", "n_name AS r_name"))


@query(f"SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM {_MORE} WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")
def insert_or_ignore(t):
    return changes.insert_or_ignore(t.region, _more_regions(t), ["r_regionkey"])[0]


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (7, 'NEW'), (NULL, 'x'), (NULL, 'y')) AS m(r_regionkey, r_name)")
def insert_or_ignore_null_keys(t):
    """Keys with a NULL conflict with none; of two rows with a key the first enters."""
    rows = t._spark.createDataFrame([(3, "CHANGED"), (7, "NEW"), (None, "x"), (7, "late"), (None, "y")], "r_regionkey int, r_name string").coalesce(1)
    return changes.insert_or_ignore(t.region, rows, ["r_regionkey"])[0]


@query("SELECT r_regionkey, upper(r_name) || '!' AS name FROM (VALUES (11, 'lemuria'), (12, 'mu')) AS m(r_regionkey, r_name)")
def insert_returning(t):
    """INSERT ... RETURNING in a session's SQL."""
    from ..session import EngineSession

    session = EngineSession(t._spark)
    session.register("region", t.region.select("r_regionkey", "r_name"), "r_regionkey")
    return session.exec("INSERT INTO region VALUES (?, ?), (12, 'mu') RETURNING r_regionkey, upper(r_name) || '!' AS name", 11, "lemuria").returned


@query(f"SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (3, 7, 8) UNION ALL SELECT * FROM {_MORE}")
def insert_or_replace(t):
    return changes.insert_or_replace(t.region, _more_regions(t), ["r_regionkey"])[0]


@query(f"SELECT coalesce(r.r_regionkey, m.r_regionkey) AS r_regionkey, CASE WHEN m.r_regionkey IS NULL THEN r.r_name WHEN r.r_regionkey IS NULL THEN m.r_name ELSE r.r_name || '>' || m.r_name END AS r_name FROM region r FULL JOIN {_MORE} ON r.r_regionkey = m.r_regionkey")
def upsert(t):
    return changes.upsert(t.region, _more_regions(t), ["r_regionkey"], {"r_name": "r_name || '>' || excluded.r_name"})[0]


@query("SELECT s_suppkey, s_name, s_nationkey, round(CASE WHEN s_nationkey = 3 THEN s_acctbal * 2 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")
def update_where(t):
    done, _ = changes.update(t.supplier, {"s_acctbal": F.col("s_acctbal") * 2}, F.col("s_nationkey") == 3)
    return done.withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("SELECT p_partkey, p_size FROM part WHERE nullif(p_size, 10) > 20 IS NOT TRUE")
def delete_where(t):
    """Rows for which the condition is NULL stay."""
    return changes.delete(t.part.select("p_partkey", "p_size"), F.expr("nullif(p_size, 10) > 20"))[0]


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def delete_returning(t):
    return changes.delete(t.nation, F.col("n_regionkey") == 2)[1].select("n_nationkey", "n_name")


@query("SELECT s_suppkey, upper(s_name) AS s_name FROM supplier WHERE s_acctbal < 0")
def update_returning(t):
    return changes.update(t.supplier, {"s_name": F.upper("s_name")}, F.col("s_acctbal") < 0)[1].select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_custkey, o_orderkey + o_custkey AS both_keys FROM orders")
def generated_column(t):
    table = Table("o", [Column("o_orderkey", "bigint"), Column("o_custkey", "bigint"), Column("both_keys", "bigint", generated="o_orderkey + o_custkey")])
    return table.completed(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"])


@query("SELECT 'CHECK' AS kind, count(*) AS n FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT 'FOREIGN KEY', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'UNIQUE', count(*) FROM (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1) UNION ALL SELECT 'NOT NULL', count(*) FROM customer WHERE c_name IS NULL")
def constraint_violations(t):
    nations = Table("s", [Column("k", "int")], rows=t.supplier.filter("s_acctbal > 5000").selectExpr("s_nationkey AS k").distinct())
    table = Table("customer", [Column(c, k, not_null=c == "c_name") for c, k in t.customer.dtypes], unique=[("c_nationkey",)], checks=["c_acctbal >= 0"], foreign=[ForeignKey("c_nationkey", "s", "k")])
    found = None
    for kind, bad in table.violations(t.customer, {"s": nations}).items():
        name = next(k for k in ("NOT NULL", "UNIQUE", "CHECK", "FOREIGN KEY") if kind.startswith(k))
        part = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        found = part if found is None else found.unionByName(part)
    return found
