"""The query operators: each module registers queries and their SQL twins."""

from . import aggregates, changes, functions, joins, predicates, scans, sets, sorting, streams, subqueries, windows
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "changes", "functions", "joins", "predicates", "scans", "sets", "sorting", "streams", "subqueries", "windows"]
