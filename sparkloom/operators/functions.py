"""Scalar functions: arithmetic, strings, conditions, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from .registry import query, sql

# --- arithmetic


@query("SELECT p_partkey, CAST(p_partkey // nullif(p_size % 5, 0) AS BIGINT) AS q, CAST(p_partkey % nullif(p_size % 5, 0) AS BIGINT) AS m, round(p_retailprice / nullif(p_size % 5, 0), 4) AS d FROM part")
def divide_by_zero(t):
    by = F.col("p_size") % 5
    return t.part.select("p_partkey", fn.int_divide(F.col("p_partkey"), by).alias("q"), fn.modulo(F.col("p_partkey"), by.cast("long")).alias("m"), F.round(fn.divide(F.col("p_retailprice"), by), 4).alias("d"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 2 THEN n_nationkey * 4611686018427387904 END AS a, CAST(-7 % 3 AS BIGINT) AS m, CAST(-(7 // 2) AS BIGINT) AS q FROM nation")
def overflow_is_null(t):
    big = F.lit(2**62)
    return t.nation.select("n_nationkey", fn.multiply(big, F.col("n_nationkey").cast("long")).alias("a"), fn.modulo(F.lit(-7).cast("long"), F.lit(3).cast("long")).alias("m"), fn.int_divide(F.lit(-7), 2).alias("q"))


sql("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax - l_discount, 4) AS x, round(-l_quantity, 2) AS n, round(+l_tax, 4) AS p FROM lineitem")


@query("SELECT n_nationkey, CAST(n_nationkey & 3 AS BIGINT) AS a, CAST(n_nationkey | 4 AS BIGINT) AS o, CAST(xor(n_nationkey, 5) AS BIGINT) AS x, CAST(~n_nationkey AS BIGINT) AS n FROM nation")
def bitwise(t):
    k = F.col("n_nationkey")
    return t.nation.select("n_nationkey", fn.bit_and(k, 3).alias("a"), fn.bit_or(k, 4).alias("o"), fn.bit_xor(k, 5).alias("x"), fn.bit_not(k).alias("n"))


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS a, round(CAST(c_acctbal AS DOUBLE)) AS r, round(CAST(c_acctbal AS DOUBLE), 1) AS r1, CAST(sign(c_acctbal) AS BIGINT) AS s, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10, nullif(c_nationkey, 3)) AS l FROM customer")
def numeric_functions(t):
    b, k = F.col("c_acctbal"), F.col("c_nationkey")
    return t.customer.select("c_custkey", F.round(F.abs(b), 2).alias("a"), fn.sql_round(b).alias("r"), fn.sql_round(b, 1).alias("r1"), fn.sign(b).alias("s"), fn.scalar_max(k, 10).alias("g"), fn.scalar_min(k, 10, F.nullif(k, F.lit(3))).alias("l"))


@query("SELECT r_regionkey, TRUE AS inside FROM region")
def random_integer(t):
    r = fn.random_int()
    return t.region.select("r_regionkey", ((r >= -(2**63)) & (r <= 2**63 - 1)).alias("inside"))


# --- strings


@query("SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_mktsegment) AS w, CAST(length(c_name) AS BIGINT) AS l, CAST(strlen(c_name || 'é') AS BIGINT) AS ol, substr(c_name, 1, 4) AS s, substr(c_name, 1, 3) AS s0, CAST(instr(c_name, '0') AS BIGINT) AS i, 0::BIGINT AS i0, replace(c_name, '0', 'o') AS r, c_name || '-' || c_mktsegment AS cc, concat_ws('/', c_name, nullif(c_mktsegment, 'BUILDING')) AS w2 FROM customer")
def string_functions(t):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", F.upper(segment).alias("u"), F.lower(segment).alias("w"), F.length(name).cast("long").alias("l"), fn.octet_length(F.concat(name, F.lit("é"))).alias("ol"), fn.substr(name, 1, 4).alias("s"), fn.substr(name, 0, 3).alias("s0"),
        fn.instr(name, "0").alias("i"), fn.instr(name, None).alias("i0"), fn.replace(name, "0", "o").alias("r"), fn.concat(name, "-", segment).alias("cc"), fn.concat_ws("/", name, F.nullif(segment, F.lit("BUILDING"))).alias("w2"),
    )


@query("SELECT n_nationkey, trim('  ' || n_name || ' ') AS t, ltrim('xx' || n_name, 'x') AS l, rtrim(n_name || 'yzy', 'yz') AS r, trim('-' || n_name || '+', '-+') AS b FROM nation")
def trim_functions(t):
    name = F.col("n_name")
    return t.nation.select("n_nationkey", fn.trim_chars(F.concat(F.lit("  "), name, F.lit(" "))).alias("t"), fn.trim_chars(F.concat(F.lit("xx"), name), "x", "leading").alias("l"), fn.trim_chars(F.concat(name, F.lit("yzy")), "yz", "trailing").alias("r"), fn.trim_chars(F.concat(F.lit("-"), name, F.lit("+")), "-+").alias("b"))


@query("SELECT n_nationkey, hex(CAST(n_nationkey AS VARCHAR)) AS h, hex(n_name) AS h2, CAST(unhex(hex(n_name)) AS VARCHAR) AS u, CAST(unicode(n_name) AS BIGINT) AS c, chr(n_nationkey + 955) AS ch, '''' || replace(n_name, '''', '''''') || '''' AS q, n_name || ' is ' || printf('%05d', n_nationkey) AS f FROM nation")
def text_codes(t):
    k, name = F.col("n_nationkey"), F.col("n_name")
    return t.nation.select("n_nationkey", fn.hex_text(k).alias("h"), fn.hex_text(name).alias("h2"), fn.unhex(fn.hex_text(name)).cast("string").alias("u"), fn.unicode_of(name).alias("c"), fn.char_of(k + 955).alias("ch"), fn.quote(name).alias("q"), fn.format_text("%v is %05d", name, k).alias("f"))


@query("SELECT r_regionkey, CAST(NULL AS VARCHAR) AS odd, '?000' AS s0, 'NULL' AS q, 'aλ' || chr(10) AS u, CAST(4 AS BIGINT) AS z FROM region")
def text_edge_cases(t):
    return t.region.select("r_regionkey", fn.unhex(F.lit("abc")).cast("string").alias("odd"), fn.soundex(F.lit("123")).alias("s0"), fn.quote(F.lit(None).cast("string")).alias("q"), fn.unistr(F.lit("a\\u03bb\\n")).alias("u"), F.length(fn.zero_blob(4)).cast("long").alias("z"))


@query()
def soundex_code(t):
    """DuckDB has no soundex."""
    return t.nation.select("n_nationkey", fn.soundex(F.col("n_name")).alias("s"))


@query("SELECT r_regionkey, CAST(16 AS BIGINT) AS n FROM region")
def random_bytes(t):
    return t.region.select("r_regionkey", F.length(fn.random_blob(16)).cast("long").alias("n"))


# --- conditions, casts, types

sql("conditional_functions", "SELECT p_partkey, coalesce(nullif(p_size % 3, 0), -1) AS c, ifnull(nullif(p_brand, 'Brand#11'), 'none') AS i, nullif(p_size, 7) AS n, if(p_size > 25, 'big', 'small') AS f FROM part")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS f, CASE WHEN p_size > 25 THEN p_size END AS n, p_size > 25 AS l FROM part")
def iif_functions(t):
    big = F.col("p_size") > 25
    return t.part.select("p_partkey", fn.iif(big, "big", "small").alias("f"), fn.iif(big, F.col("p_size")).alias("n"), fn.likelihood(big, 0.9).alias("l"))


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderkey AS VARCHAR) AS t, CAST(CAST(o_totalprice AS DECIMAL(12, 1)) AS VARCHAR) AS m, o_orderkey % 2 <> 0 AS b, CAST(NULL AS BIGINT) AS bad FROM orders")
def casts(t):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select("o_orderkey", fn.cast_int(price).alias("i"), fn.cast_real(k).alias("d"), fn.cast_text(k).alias("t"), fn.cast_decimal(price, 12, 1).cast("string").alias("m"), fn.cast_bool(k % 2).alias("b"), fn.cast_int(F.lit("pear")).alias("bad"))


@query("SELECT p_partkey, 'integer' AS a, 'text' AS b, 'real' AS c, CASE WHEN p_size % 5 = 0 THEN 'null' ELSE 'integer' END AS d FROM part")
def type_names(t):
    df = t.part.withColumn("v", F.nullif(F.col("p_size") % 5, F.lit(0)))
    return df.select("p_partkey", *(fn.sql_typeof(df, c).alias(x) for c, x in (("p_partkey", "a"), ("p_name", "b"), ("p_retailprice", "c"), ("v", "d"))))


@query("SELECT CAST(CAST(1.10 AS DECIMAL(10, 2)) + CAST(2.25 AS DECIMAL(10, 2)) AS VARCHAR) AS a, CAST(CAST(1.10 AS DECIMAL(10, 2)) * CAST(2.25 AS DECIMAL(10, 2)) AS VARCHAR) AS m, CAST(1.10 AS DECIMAL(10, 2)) < CAST(2.25 AS DECIMAL(10, 2)) AS l")
def decimal_arithmetic(t):
    a, b = (fn.cast_decimal(F.lit(x), 10, 2) for x in ("1.10", "2.25"))
    return t._spark.range(1).select((a + b).cast("string").alias("a"), (a * b).cast("string").alias("m"), (a < b).alias("l"))


# --- dates and times

_FIELDS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DOW", "DOY", "WEEK")


@query("SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS {f.lower()}_" for f in _FIELDS) + " FROM events")
def date_parts(t):
    return t.events.select("event_id", *(fn.extract_field(f, F.col("ts")).alias(f"{f.lower()}_") for f in _FIELDS))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%j|%w|%I %p%%') AS b, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t FROM events")
def strftime(t):
    ts = F.col("ts")
    return t.events.select("event_id", fn.datetime_text(ts).alias("a"), fn.strftime("%j|%w|%I %p%%", ts).alias("b"), fn.date_text(ts).alias("d"), fn.time_text(ts).alias("t"))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS TIMESTAMP) AS d1, o_orderdate - INTERVAL 7 DAY AS d2, o_orderdate + INTERVAL 90 MINUTE AS d3 FROM orders")
def date_add(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", fn.add_interval(d, 1, "MONTH").alias("d1"), fn.add_interval(d, -7, "DAYS").alias("d2"), fn.add_interval(d, 90, "MINUTE").alias("d3"))


@query("SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS BIGINT) AS dd FROM orders")
def date_diff(t):
    return t.orders.select("o_orderkey", fn.date_diff_days(F.lit("2000-01-01"), F.col("o_orderdate")).alias("dd"))


@query("SELECT o_orderkey, julian(o_orderdate) - 0.5 AS j FROM orders")
def julian_day(t):
    return t.orders.select("o_orderkey", fn.julian_day(F.col("o_orderdate")).alias("j"))


@query("SELECT r_regionkey, TRUE AS later FROM region")
def current_times(t):
    return t.region.select("r_regionkey", ((F.current_timestamp() > F.lit("2020-01-01")) & (F.current_date() > F.lit("2020-01-01"))).alias("later"))


# --- JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS n, CAST(json_valid(props) AS BIGINT) AS v, CASE json_type(props) WHEN 'OBJECT' THEN 'object' END AS t FROM events")
def json_read(t):
    props = F.col("props")
    return t.events.select("event_id", fn.json_extract(props, "k").cast("long").alias("k"), fn.json_extract(props, "none").alias("n"), fn.json_valid(props).alias("v"), fn.json_type(props).alias("t"))


@query("""SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '",null]' AS a, '{"k":' || n_nationkey || ',"name":"' || n_name || '"}' AS o, '{"k":' || n_nationkey || ',"name":"' || n_name || '","x":{"y":1}}' AS s FROM nation""")
def json_write(t):
    k, name = F.col("n_nationkey"), F.col("n_name")
    made = fn.json_object(name=name, k=k)
    return t.nation.select("n_nationkey", fn.json_array(k, name, F.lit(None).cast("string")).alias("a"), made.alias("o"), fn.json_set(made, "x.y", F.lit(1)).alias("s"))


@query("""SELECT * FROM (VALUES ('{"a":{"b":[10,20]}}', '20', 'object', 1::BIGINT), ('[1]', NULL, 'array', 1), ('3.5', NULL, 'real', 1), ('"x"', NULL, 'text', 1), ('true', NULL, 'integer', 1), ('null', NULL, 'null', 1), ('{bad', NULL, NULL, 0)) AS t(j, e, t, v)""")
def json_kinds(t):
    texts = ['{"a":{"b":[10,20]}}', "[1]", "3.5", '"x"', "true", "null", "{bad"]
    rows = t._spark.createDataFrame([(x,) for x in texts], "j string")
    j = F.col("j")
    return rows.select("j", fn.json_extract(j, "a.b.1").alias("e"), fn.json_type(j).alias("t"), fn.json_valid(j).alias("v"))
