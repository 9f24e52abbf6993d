"""Dates and times; format strings are translated when the plan is made."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime verbs that are patterns of date_format.
_PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS"}


def _timestamp(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("timestamp_ntz")


def strftime(pattern: str, x) -> Column:
    """%Y %m %d %H %M %S %f %j %I %p, %w (0 is Sunday), %U (ISO week), %P (like %p) and %%."""
    at, parts = _timestamp(x), []
    for piece in re.findall(r"%.|[^%]+", pattern, re.DOTALL):
        verb = piece[1] if piece[0] == "%" and len(piece) > 1 else None
        if verb is None or verb == "%":
            parts.append(F.lit("%" if verb else piece))
        elif verb == "w":
            parts.append((F.dayofweek(at) - 1).cast("string"))
        elif verb == "U":
            parts.append(F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
        elif verb in _PATTERNS or verb == "P":
            parts.append(F.date_format(at, _PATTERNS.get(verb, "a")))
        else:  # an unknown verb stays as it is
            parts.append(F.lit(piece))
    return F.concat(*parts)


def extract_field(field: str, x) -> Column:
    """YEAR MONTH DAY HOUR MINUTE SECOND DOW (0 is Sunday) DOY WEEK (ISO), as longs."""
    at = _timestamp(x)
    made = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear, "WEEK": F.weekofyear, "DOW": lambda c: F.dayofweek(c) - 1}
    return made[field.upper()](at).cast("long")


def julian_day(x) -> Column:
    days = F.datediff(_timestamp(x).cast("date"), F.lit("1970-01-01").cast("date"))
    at = _timestamp(x)
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECOND"), at).cast("double")
    return F.lit(2440587.5) + days + seconds / F.lit(86400.0)


def date_text(x) -> Column:
    return F.date_format(_timestamp(x), "yyyy-MM-dd")


def time_text(x) -> Column:
    return F.date_format(_timestamp(x), "HH:mm:ss")


def datetime_text(x) -> Column:
    return F.date_format(_timestamp(x), "yyyy-MM-dd HH:mm:ss")


def add_interval(x, amount: int, unit: str) -> Column:
    """A timestamp moved by whole units; months clamp to the last day."""
    unit = unit.upper().rstrip("S")
    if unit not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
        raise ValueError(f"unknown unit {unit}")
    return _timestamp(x) + F.expr(f"INTERVAL '{int(amount)}' {unit}")


def date_diff_days(a, b) -> Column:
    """Whole days from b to a."""
    return F.datediff(_timestamp(a).cast("date"), _timestamp(b).cast("date")).cast("long")
