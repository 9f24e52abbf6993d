from datetime import date, datetime
from decimal import Decimal

import pytest

from sparkloom.plans.dialect import translate
from sparkloom.plans.errors import ConstraintViolation, Duplicate, EngineError, NotFound, ReadOnly, SyntaxFault
from sparkloom.session import EngineSession

from .conftest import DATA


@pytest.fixture()
def session(spark):
    s = EngineSession(spark)
    s.exec("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, email TEXT UNIQUE, age INT DEFAULT 18)")
    s.exec("INSERT INTO users VALUES (1, 'ann', 'a@x', 30), (2, 'bob', NULL, NULL)")
    s.exec("INSERT INTO users (id, name) VALUES (3, 'it''s')")
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, text, *args):
    return EngineSession(spark).sql(text, *args).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT 7 / 2", 3),
        ("SELECT -7 / 2", -3),
        ("SELECT 7.0 / 2", 3.5),
        ("SELECT 5 / 0", None),
        ("SELECT 5 % 0", None),
        ("SELECT -7 % 3", -1),
        ("SELECT 1 + 2 * 3 - 4 / 2", 5),
        ("SELECT (1 + 2) * 3", 9),
        ("SELECT 9223372036854775807 + 1", None),
        ("SELECT IIF(1 > 2, 'a', 'b')", "b"),
        ("SELECT IFNULL(NULL, 4)", 4),
        ("SELECT MAX(1, 3, NULL)", 3),
        ("SELECT MIN(4, 2)", 2),
        ("SELECT SUBSTR('hello', 0, 2)", "he"),
        ("SELECT SUBSTR('hello', 2, -1)", ""),
        ("SELECT INSTR('abc', 'c')", 3),
        ("SELECT INSTR(NULL, 'c')", 0),
        ("SELECT HEX(255)", "323535"),
        ("SELECT UNHEX('abc')", None),
        ("SELECT QUOTE('it''s')", "'it''s'"),
        ("SELECT QUOTE(NULL)", "NULL"),
        ("SELECT CHAR(955, 65)", "λA"),
        ("SELECT UNICODE('é')", 233),
        ("SELECT SOUNDEX('123')", "?000"),
        ("SELECT SIGN(-2.5)", -1),
        ("SELECT ROUND(2.5)", 3.0),
        ("SELECT ROUND(-2.5)", -3.0),
        ("SELECT TYPEOF(1)", "integer"),
        ("SELECT TYPEOF('x')", "text"),
        ("SELECT TYPEOF(NULL)", "null"),
        ("SELECT TYPEOF(1.5D)", "real"),
        ("SELECT GLOB('a*c?', 'abbcd')", True),
        ("SELECT FORMAT('%d-%s', 5, 'x')", "5-x"),
        ("SELECT CONCAT('a', NULL)", None),
        ("SELECT CONCAT_WS('-', 'a', NULL, 'b')", "a-b"),
        ("SELECT 'a' || 'b'", "ab"),
        ("SELECT TRIM('xxaxx', 'x')", "a"),
        ("SELECT REPLACE('aXb', 'X', NULL)", "ab"),
        ("SELECT CAST('12' AS INTEGER)", 12),
        ("SELECT CAST(3.99D AS INT)", 3),
        ("SELECT EXTRACT('DOW', '2024-01-07')", 0),
        ("SELECT STRFTIME('%Y/%m/%d %w', '2024-03-05 12:00:00')", "2024/03/05 2"),
        ("SELECT JULIANDAY('2024-03-05 12:00:00')", 2460375.0),
        ("SELECT DATETIME('2024-03-05 01:02:03')", "2024-03-05 01:02:03"),
        ("SELECT JSON_EXTRACT('{\"a\":{\"b\":[1,2]}}', 'a.b.1')", "2"),
        ("SELECT JSON_VALID('{bad')", 0),
        ("SELECT '{\"a\":[5,6]}' -> 'a' ->> 1", "6"),
        ("SELECT JSON_ARRAY(1, 'x', NULL)", '[1,"x",null]'),
        ("SELECT JSON_OBJECT('b', 2, 'a', 1)", '{"a":1,"b":2}'),
        ("SELECT LENGTH('café')", 4),
        ("SELECT LENGTH('a\\b')", 3),
        ("SELECT 'a\\nb'", "a\\nb"),
        ("SELECT STRFTIME('%H\\%M', '2024-03-05 12:30:00')", "12\\30"),
        ("SELECT count(*) FROM VALUES (1), (2) AS t(a) WHERE a * -1 < -a + 1", 2),
        ("SELECT DATETIME(CAST('2024-01-31' AS TIMESTAMP) + INTERVAL '1' MONTH)", "2024-02-29 00:00:00"),
        ("SELECT OCTET_LENGTH('café')", 5),
        ("SELECT CASE WHEN 1 = 1 THEN 10 / 4 ELSE 0 END", 2),
        ("SELECT NULL IN (1)", None),
        ("SELECT 2 NOT IN (1, NULL)", None),
        ("SELECT 1 == 1", True),
        ("SELECT COALESCE(NULL, NULL, 3) -- a comment", 3),
        ("SELECT LIKELIHOOD(5, 0.5)", 5),
        ("SELECT 5 & 3 | 8", 9),
    ],
)
def test_expression(spark, text, want):
    assert one(spark, text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT (-7) / 2", -3),
        ("SELECT 'CHANGES()'", "CHANGES()"),
        ("SELECT ROUND(123.4, -1)", 123.0),
        ("SELECT 3 IS NOT 4", True),
        ("SELECT NULL IS 4", False),
        ("SELECT 4 IS NOT NULL", True),
        ("SELECT JSON_TYPE('[1]')", "array"),
        ("SELECT JSON_TYPE('{\"a\":{\"b\":\"x\"}}', 'a.b')", "text"),
        ("SELECT JSON_TYPE('nothing')", None),
        ("SELECT JSON_SET('{\"a\":1}', 'b.c', 2)", '{"a":1,"b":{"c":2}}'),
        ("SELECT JSON_SET('[1,2]', '1', 'x')", '[1,"x"]'),
        ("SELECT UNISTR('\\0041 \\u00e9')", "\\0041 é"),
        ("SELECT STRFTIME('%Y %q', '2020-01-02')", "2020 %q"),
        ("SELECT JULIANDAY('2000-01-01 12:00:00.5') > JULIANDAY('2000-01-01 12:00:00')", True),
        ("SELECT k FROM (VALUES (1), (2)) AS t(k) ORDER BY k DESC FETCH FIRST 1 ROW ONLY", 2),
    ],
)
def test_more_expressions(spark, text, want):
    assert one(spark, text) == want


def test_not_in_of_a_subquery(spark):
    session = EngineSession(spark)
    big = "SELECT id FROM range(0, 50)"
    assert rows(session.sql(f"SELECT k FROM (VALUES (7), (99), (NULL)) AS t(k) WHERE k NOT IN ({big})")) == [(99,)]
    assert rows(session.sql(f"SELECT k FROM (VALUES (7), (99)) AS t(k) WHERE k > 0 AND k NOT IN (SELECT nullif(id, 3) FROM ({big}))")) == []
    assert rows(session.sql(f"SELECT k FROM (VALUES (7), (NULL)) AS t(k) WHERE k NOT IN (SELECT id FROM ({big}) WHERE id < 0)")) == [(7,), (None,)]
    assert rows(session.sql(f"SELECT k FROM (VALUES (7), (99)) AS t(k) WHERE k = 7 OR k NOT IN ({big})")) == [(7,), (99,)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = session.explain(f"SELECT id FROM range(1000) WHERE id NOT IN ({big})")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_parameters_of_any_kind(spark):
    session = EngineSession(spark)
    session.exec("CREATE TABLE p (k INTEGER PRIMARY KEY, t TEXT, d DECIMAL(10,2), b BLOB, x REAL, at TIMESTAMP, on_day DATE)")
    session.exec("INSERT INTO p VALUES (?, ?, ?, ?, ?, ?, ?) -- why?", -1, "what? 'it' \\ -- ?", Decimal("1.50"), b"\x00\xff", float("inf"), datetime(2020, 1, 2, 3, 4, 5), date(2021, 1, 1))
    assert tuple(session.table("p").first()) == (-1, "what? 'it' \\ -- ?", Decimal("1.50"), bytearray(b"\x00\xff"), float("inf"), datetime(2020, 1, 2, 3, 4, 5), date(2021, 1, 1))
    assert session.exec("DELETE FROM p WHERE k = 0 -?", 1).affected == 1
    for given in ((), (1, 2)):
        with pytest.raises(SyntaxFault):
            session.exec("DELETE FROM p WHERE k = ?", *given)


def test_null_keys_and_winners(spark):
    session = EngineSession(spark)
    session.exec("CREATE TABLE u (id INTEGER PRIMARY KEY, email TEXT UNIQUE)")
    session.exec("INSERT OR IGNORE INTO u VALUES (1, NULL), (2, NULL), (3, 'a')")
    assert rows(session.table("u")) == [(1, None), (2, None), (3, "a")]
    assert session.exec("INSERT OR IGNORE INTO u VALUES (3, 'z'), (4, 'a'), (5, 'b'), (5, 'c'), (6, 'b'), (6, 'd')").affected == 2
    assert rows(session.table("u")) == [(1, None), (2, None), (3, "a"), (5, "b"), (6, "d")]
    session.exec("REPLACE INTO u VALUES (3, 'first'), (3, 'b'), (9, NULL)")
    assert rows(session.table("u")) == [(1, None), (2, None), (3, "b"), (6, "d"), (9, None)]
    session.exec("INSERT INTO u VALUES (6, 'x'), (6, 'y') ON CONFLICT (id) DO UPDATE SET email = excluded.email")
    assert rows(session.sql("SELECT email FROM u WHERE id = 6")) == [("y",)]


def test_transactions(session):
    before = rows(session.table("users"))
    session.exec("BEGIN")
    session.exec("DELETE FROM users WHERE id = 1")
    session.exec("SAVEPOINT one")
    session.exec("INSERT INTO users (id, name) VALUES (50, 'x')")
    session.exec("CREATE TABLE other (k INT)")
    session.exec("ALTER TABLE users ADD COLUMN more TEXT")
    session.exec("ROLLBACK TO one")
    assert rows(session.sql("SELECT id FROM users")) == [(2,), (3,)] and "other" not in session.tables and "more" not in session.table("users").columns
    with pytest.raises(EngineError):
        session.exec("VACUUM")
    session.exec("ROLLBACK")
    assert rows(session.table("users")) == before
    for text in ("ROLLBACK", "COMMIT", "RELEASE one"):
        with pytest.raises(EngineError):
            session.exec(text)
    session.exec("BEGIN TRANSACTION")
    session.exec("DELETE FROM users")
    session.exec("COMMIT")
    assert rows(session.table("users")) == []


def test_an_insert_writes_its_rows_alone(spark, tmp_path):
    session = EngineSession(spark, f"file://{tmp_path}")
    session.exec("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    session.exec("INSERT INTO t SELECT id, 'x' FROM range(1000)")
    session.exec("INSERT INTO t VALUES (5000, 'y')")
    folders = [sum(1 for f in p.iterdir() if f.suffix == ".parquet") for p in sorted((tmp_path / "t").iterdir(), key=lambda p: p.stat().st_mtime)]
    sizes = [spark.read.parquet(f"file://{p}").count() for p in sorted((tmp_path / "t").iterdir(), key=lambda p: p.stat().st_mtime)]
    assert len(folders) == 2 and sizes == [1000, 1] and session.table("t").count() == 1001
    with pytest.raises(ConstraintViolation):
        session.exec("INSERT INTO t VALUES (7000, 'a'), (999, 'b')")
    assert session.table("t").count() == 1001 and one_of(session, "SELECT LAST_INSERT_ROWID()") == 5000


def test_errors_are_the_engines(session):
    for text, kind in (("SELECT nothing FROM users", NotFound), ("SELECT 1 FROM nowhere", NotFound), ("SELECT NO_SUCH(1)", NotFound), ("SELECT 1 FROM (users", SyntaxFault), ("SELECT 1 1 1", SyntaxFault)):
        with pytest.raises(kind):
            session.sql(text)


def test_division_of_columns(spark):
    s = EngineSession(spark)
    s.register("t", spark.createDataFrame([(7, 2, 7.0), (7, 0, 1.0)], "a long, b long, c double"))
    assert rows(s.sql("SELECT a / b AS q, c / b AS f FROM t")) == [(3.0, 3.5), (None, None)]


def test_group_concat_and_windows(spark):
    s = EngineSession(spark)
    s.register("t", spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string"))
    assert rows(s.sql("SELECT k, GROUP_CONCAT(DISTINCT v) AS g FROM t GROUP BY k")) == [(1, "a"), (2, "b")]
    assert rows(s.sql("SELECT k, SUM(k * 2) OVER (PARTITION BY v ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS s FROM t")) == [(1, 3), (1, 5), (2, 5)]


def test_translate_keeps_queries():
    text = "WITH a AS (SELECT x.k, count(*) AS n FROM t AS x WHERE x.v LIKE 'a%' GROUP BY x.k) SELECT * FROM a WHERE n IN (1, 2) ORDER BY n DESC LIMIT 3"
    assert translate(text).replace(" ", "").lower() == text.replace(" ", "").lower()


def test_syntax_errors(session):
    for text in ("SELECT (1", "FROB x", "", "INSERT INTO users", "UPDATE users", "SELECT #"):
        with pytest.raises(SyntaxFault):
            session.exec(text)


def test_insert_defaults_and_returning(session):
    assert rows(session.sql("SELECT id, name, age FROM users")) == [(1, "ann", 30), (2, "bob", None), (3, "it's", 18)]
    done = session.exec("INSERT INTO users (id, name, age) VALUES (?, ?, ?) RETURNING id, age + 1 AS older", 4, "dan", 40)
    assert done.affected == 1 and rows(done.returned) == [(4, 41)]
    assert one_of(session, "SELECT CHANGES()") == 1 and one_of(session, "SELECT TOTAL_CHANGES()") == 4


def one_of(session, text):
    return session.sql(text).first()[0]


def test_insert_select(session):
    session.exec("INSERT INTO users (id, name) SELECT id + 10, upper(name) FROM users")
    assert one_of(session, "SELECT count(*) FROM users") == 6


def test_constraints(session):
    for text, kind in (("INSERT INTO users VALUES (1, 'x', 'b@x', 1)", "UNIQUE"), ("INSERT INTO users VALUES (9, NULL, 'b@x', 1)", "NOT NULL"), ("INSERT INTO users VALUES (9, 'x', 'a@x', 1)", "UNIQUE"), ("UPDATE users SET email = 'same'", "UNIQUE"), ("INSERT INTO users (name) VALUES ('x')", "NOT NULL")):
        with pytest.raises(ConstraintViolation) as e:
            session.exec(text)
        assert e.value.kind.startswith(kind)
    assert one_of(session, "SELECT count(*) FROM users") == 3


def test_check_and_foreign_keys(spark):
    s = EngineSession(spark)
    s.exec("CREATE TABLE a (k INT PRIMARY KEY, v INT CHECK (v > 0))")
    s.exec("CREATE TABLE b (k INT REFERENCES a(k), CHECK (k < 100))")
    s.exec("INSERT INTO a VALUES (1, 5), (2, NULL)")
    s.exec("INSERT INTO b VALUES (1), (NULL)")
    for text in ("INSERT INTO a VALUES (3, 0)", "INSERT INTO b VALUES (7)", "DELETE FROM a WHERE k = 1", "UPDATE a SET k = 9 WHERE k = 1"):
        with pytest.raises(ConstraintViolation):
            s.exec(text)
    s.exec("DELETE FROM a WHERE k = 2")
    assert s.integrity_check() == ["ok"]


def test_generated_columns(spark):
    s = EngineSession(spark)
    s.exec("CREATE TABLE g (x INT, y INT, s INT AS (x + y) STORED)")
    s.exec("INSERT INTO g (x, y) VALUES (1, 2), (3, 4)")
    s.exec("UPDATE g SET x = 10 WHERE y = 2")
    assert rows(s.sql("SELECT * FROM g")) == [(10, 2, 12), (3, 4, 7)]
    with pytest.raises(ConstraintViolation):
        s.exec("INSERT INTO g (x, s) VALUES (1, 2)")


def test_conflicts(session):
    assert session.exec("INSERT OR IGNORE INTO users VALUES (1, 'x', NULL, 1), (5, 'eve', NULL, 5)").affected == 1
    session.exec("INSERT OR REPLACE INTO users VALUES (2, 'rob', NULL, 2)")
    session.exec("INSERT INTO users VALUES (3, 'y', 'y@x', 9) ON CONFLICT (id) DO UPDATE SET age = age + excluded.age, name = excluded.name")
    session.exec("INSERT INTO users VALUES (3, 'z', NULL, 9) ON CONFLICT (id) DO NOTHING")
    session.exec("REPLACE INTO users VALUES (1, 'amy', NULL, 31)")
    assert rows(session.sql("SELECT id, name, age FROM users")) == [(1, "amy", 31), (2, "rob", 2), (3, "y", 27), (5, "eve", 5)]


def test_update_and_delete(session):
    done = session.exec("UPDATE users SET age = coalesce(age, 0) + 1, name = name || '!' WHERE id < ? RETURNING id, name", 3)
    assert done.affected == 2 and rows(done.returned) == [(1, "ann!"), (2, "bob!")]
    assert session.exec("DELETE FROM users WHERE age > 20").affected == 1
    assert session.exec("DELETE FROM users WHERE email = 'none'").affected == 0  # NULL conditions keep rows
    assert rows(session.sql("SELECT id FROM users")) == [(2,), (3,)]
    session.exec("UPDATE users SET name = 'a\\b' || CASE WHEN id = 2 THEN '?' ELSE 'x' END, age = 1.5 * 2")
    assert rows(session.sql("SELECT name, age FROM users")) == [("a\\b?", 3), ("a\\bx", 3)]
    session.exec("DELETE FROM users")
    assert rows(session.sql("SELECT * FROM users")) == []


def test_alter_table(session):
    session.exec("ALTER TABLE users ADD COLUMN score REAL DEFAULT 1.5")
    session.exec("ALTER TABLE users RENAME COLUMN age TO years")
    session.exec("ALTER TABLE users DROP COLUMN email") if False else None
    assert set(session.table("users").columns) == {"id", "name", "email", "years", "score"}
    session.exec("ALTER TABLE users RENAME TO people")
    assert one_of(session, "SELECT sum(score) FROM people") == 4.5
    with pytest.raises(NotFound):
        session.table("users")
    with pytest.raises(ConstraintViolation):
        session.exec("ALTER TABLE people ADD COLUMN must INT NOT NULL")


def test_views_indexes_and_drops(session):
    session.exec("CREATE VIEW adults AS SELECT id, age FROM users WHERE age >= 18")
    assert rows(session.sql("SELECT id FROM adults WHERE age > 20")) == [(1,)]
    session.exec("CREATE INDEX by_age ON users (age)")
    with pytest.raises(ConstraintViolation):
        session.exec("INSERT INTO users VALUES (8, 'p', NULL, 30)") if session.exec("CREATE UNIQUE INDEX one_age ON users (age)") else None
    session.exec("DROP INDEX by_age")
    session.exec("DROP VIEW adults")
    with pytest.raises(Duplicate):
        session.exec("CREATE TABLE users (id INT)")
    session.exec("DROP TABLE users")
    session.exec("DROP TABLE IF EXISTS users")
    with pytest.raises(NotFound):
        session.exec("DROP TABLE users")


def test_prepared(session):
    statement = session.prepare("SELECT name FROM users WHERE id = ? OR age = ?")
    assert statement.parameters == 2 and rows(statement.query(2, 30)) == [("ann",), ("bob",)]
    with pytest.raises(SyntaxFault):
        statement.query(1)
    assert session.prepare("DELETE FROM users WHERE id = ?").execute(1).affected == 1


def test_pragma_explain_analyze_vacuum(session, tmp_path):
    assert one_of(session, "PRAGMA cache_size") == "-2000"
    session.sql("PRAGMA user_version = 7")
    assert one_of(session, "PRAGMA user_version") == "7" and one_of(session, "PRAGMA integrity_check") == "ok"
    assert session.sql("EXPLAIN SELECT * FROM users WHERE id = 1").count() > 1
    found = {r["column"]: r for r in session.exec("ANALYZE users").returned.collect()}
    assert found["age"]["nulls"] == 1 and found["id"]["greatest"] == "3"
    session.exec("VACUUM")
    assert one_of(session, "SELECT count(*) FROM users") == 3
    session.backup(str(tmp_path / "copy"))
    session.exec("DELETE FROM users")
    session.restore(str(tmp_path / "copy"), ["users"])
    assert one_of(session, "SELECT count(*) FROM users") == 3
    assert "users" in session.schema_dump()[0] and session.stats()["tables"] == 1
    assert [r[0] for r in session.rows("SELECT id FROM users ORDER BY id")] == [1, 2, 3]


def test_read_only(spark):
    s = EngineSession(spark, read_only=True)
    s.load_dir(f"{DATA}/sf0.001", ("nation",))
    assert s.sql("SELECT * FROM nation").count() == 25
    with pytest.raises(ReadOnly):
        s.exec("DELETE FROM nation")
    with pytest.raises(EngineError):
        s.table("missing")
