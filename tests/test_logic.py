import hashlib

from sparkloom.plans.logictest import run
from sparkloom.session import EngineSession

SCRIPT = """
# parcels and the depots they wait in
statement ok
CREATE TABLE parcels (code INTEGER PRIMARY KEY, depot TEXT, grams INTEGER, paid REAL)

statement ok
INSERT INTO parcels (depot, code, grams, paid) VALUES ('north', 1, 250, 4.5), ('south', 2, 900, NULL)

statement ok
INSERT INTO parcels VALUES (3, 'north', 4000, 19.25)

statement ok
UPDATE parcels SET grams = grams + 50 WHERE depot = 'south'

hash-threshold 6

query TI rowsort
SELECT depot, sum(grams) FROM parcels GROUP BY depot
----
north
4250
south
950

query IT valuesort
SELECT max(code), 'no. ' || min(code) FROM parcels
----
3
no. 1

query R nosort
SELECT paid FROM parcels WHERE paid IS NOT 19.25 ORDER BY code
----
4.500
NULL

query T nosort
SELECT CASE depot WHEN 'north' THEN 'cold' ELSE 'warm' END FROM parcels WHERE grams / 2 >= 475 ORDER BY code DESC
----
cold
warm

query II rowsort
SELECT code, grams FROM parcels
----
6 values hashing to HASH

statement error
INSERT INTO parcels VALUES (3, 'north', 1, 1.0)

statement error
SELECT weight FROM parcels

skipif sparkloom
statement ok
THIS IS SKIPPED

onlyif another
query I nosort
SELECT 1
----
2

halt

statement ok
NEVER RUN
"""


def test_script(spark):
    script = SCRIPT.replace("HASH", hashlib.md5(b"1\n250\n2\n950\n3\n4000\n").hexdigest())
    report = run(EngineSession(spark), script)
    assert report.failures == [] and report.passed == 11 and report.skipped == 2


def test_failures_are_told(spark):
    report = run(EngineSession(spark), "query I nosort\nSELECT 1\n----\n2\n\nstatement error\nSELECT 1\n\nodd\n")
    assert report.passed == 0 and len(report.failures) == 3
