"""How operators register their queries and SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import TABLES, Tables, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NAMES = re.compile(rf"\b({'|'.join(TABLES)})\b")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the tables of a folder; the views it needs are made first."""
    for name in sorted(set(_NAMES.findall(text))):
        read_table(spark, f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


def sql(name: str, text: str, duck: str | None = None) -> None:
    """Registers a query in SQL; ``duck`` is its twin where the text differs."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE_SQL[name] = duck or text


def query(duck: str | None = None):
    """Registers a function of (tables) that gives a DataFrame, under its own name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if duck:
            ORACLE_SQL[f.__name__] = duck
        return f

    return put
