"""Functions, joins, changes, sources and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom import functions as fn
from sparkloom.operators.joins import asof_join, band_join, salted_join
from sparkloom.plans import changes
from sparkloom.sources import Tables, read_table, write_table
from sparkloom.streaming import read_stream, run_to_end, session_totals, sliding_counts, tumbling_totals

from .conftest import DATA


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_band_join(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 9.5), (3, -3.0)], "a long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 10.5), (3, -4.1), (4, None)], "b long, y double")
    got = rows(band_join(a, b, F.col("x"), F.col("y"), 1.0).select("a", "b"))
    assert got == [(1, 1), (2, 2)]


def test_asof_join(spark):
    a = spark.createDataFrame([("p", 5), ("p", 1), ("q", 3)], "k string, t long")
    b = spark.createDataFrame([("p", 2, "x"), ("p", 5, "y"), ("q", 4, "z")], "k string, s long, v string")
    assert rows(asof_join(a, b, ["k"], "t", "s", ["v"])) == [("p", 1, None), ("p", 5, "y"), ("q", 3, None)]


def test_salted_join(spark):
    a = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0)], "k long, v long")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k long, w string")
    assert salted_join(a, b, "k", 4).count() == 50


def test_salted_join_broadcasts_no_copies(spark):
    a = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    b = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    found = salted_join(a, b, "k")
    assert rows(found) == sorted(((i % 7, i, i % 7 * 10) for i in range(1000) if i % 7 < 5), key=str)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_json_set(spark):
    for text, path, new, want in (("{}", "a.b", 1, '{"a":{"b":1}}'), ('{"a":[1,2]}', "a.1", "x", '{"a":[1,"x"]}'), ('{"a":[1]}', "a.5", 0, '{"a":[1]}'), ("bad", "a", 1, None)):
        assert value(spark, fn.json_set(F.lit(text), path, F.lit(new))) == want


def test_unistr(spark):
    for text, want in (("a\\u00e9\\t", "aé\t"), ("\\U0001F600", "\U0001f600"), ("\\+0003bb", "λ"), ("\\q", "\\q")):
        assert value(spark, fn.unistr(F.lit(text))) == want


def test_blobs(spark):
    assert value(spark, fn.zero_blob(3)) == b"\0\0\0" and len(value(spark, fn.random_blob(7))) == 7


def test_overflow(spark):
    big = F.lit(2**63 - 1)
    assert value(spark, fn.add(big, 1)) is None and value(spark, fn.multiply(big, 2)) is None and value(spark, fn.subtract(F.lit(-(2**63)), 1)) is None
    assert value(spark, fn.int_divide(F.lit(-(2**63)), -1)) is None


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b\"c", 1.5), (2, None, None)], "k long, v string, x double")
    write_table(df, str(tmp_path / fmt), fmt)
    assert rows(read_table(spark, str(tmp_path / fmt), fmt, df.schema)) == rows(df)


def test_partitioned_sink(spark, tmp_path):
    t = Tables(spark, f"{DATA}/sf0.001")
    write_table(t.nation, str(tmp_path / "n"), partition_by=("n_regionkey",))
    found = read_table(spark, str(tmp_path / "n")).filter("n_regionkey = 2")
    assert found.count() == 5 and "PartitionFilters: [isnotnull(n_regionkey" in found._jdf.queryExecution().toString()


def test_pushdown(spark):
    t = Tables(spark, f"{DATA}/sf0.001")
    plan = t.lineitem.filter("l_quantity > 49").select("l_partkey")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
    with pytest.raises(AttributeError):
        t.missing  # noqa: B018


def test_changes_keep_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    assert rows(changes.delete(df, F.col("v") > 1)[0]) == [(1, None)]
    assert rows(changes.update(df, {"V": F.lit(0)}, F.col("v") > 1)[0]) == [(1, None), (2, 0)]
    done, touched = changes.upsert(df, spark.createDataFrame([(2, 7), (3, 8), (3, 9)], "k long, v long"), ["k"], {"v": "v + excluded.v"})
    assert done.count() == 3 and touched.count() == 2 and (2, 12) in rows(done)


def test_streams_equal_batches(spark, tmp_path):
    events = Tables(spark, f"{DATA}/sf0.001").events
    write_table(events.repartition(3), str(tmp_path / "in"))
    for make in (tumbling_totals, sliding_counts):
        stream = make(read_stream(spark, str(tmp_path / "in"), events.schema, 1))
        assert rows(run_to_end(stream)) == rows(make(events))
    assert session_totals(events).count() > 0
