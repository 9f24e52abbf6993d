"""Conditions, casts and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iif(condition, yes, no=None) -> Column:
    return F.when(condition, _column(yes)).otherwise(_column(no))


def case_of(value, branches: dict, otherwise=None) -> Column:
    """CASE value WHEN ...; a NULL value matches no branch."""
    out = None
    for key, result in branches.items():
        out = (F if out is None else out).when(_column(value) == _column(key), _column(result))
    return out.otherwise(_column(otherwise))


def cast_int(x) -> Column:
    """To a 64-bit integer: fractions are cut off, and text that is no number gives NULL."""
    return _column(x).try_cast("double").try_cast("long")


def cast_real(x) -> Column:
    return _column(x).try_cast("double")


def cast_text(x) -> Column:
    return _column(x).cast("string")


def cast_decimal(x, precision: int, scale: int) -> Column:
    """Rounded to the scale; NULL beyond the precision."""
    return _column(x).try_cast(f"decimal({precision},{scale})")


def cast_bool(x) -> Column:
    return _column(x).try_cast("boolean")


def likelihood(x, _probability: float | None = None) -> Column:
    """LIKELY, UNLIKELY and LIKELIHOOD: the value itself."""
    return _column(x)


def sql_typeof(df: DataFrame, name: str) -> Column:
    """integer, real, text, blob or null, by the column's declared type."""
    kind = dict(df.dtypes)[name]
    names = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "boolean": "integer", "float": "real", "double": "real", "binary": "blob"}
    text = "real" if kind.startswith("decimal") else names.get(kind, "text")
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.lit(text))
