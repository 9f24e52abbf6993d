"""Strings and blobs: positions count characters from 1."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def octet_length(x) -> Column:
    return F.octet_length(_column(x).cast("string")).cast("long")


def substr(s, start, length=None) -> Column:
    """A start below 1 counts as 1; a negative length gives the empty string."""
    begin = F.greatest(_column(start).cast("int"), F.lit(1))
    if length is None:
        return F.substr(_column(s), begin)
    return F.substr(_column(s), begin, F.greatest(_column(length).cast("int"), F.lit(0)))


def instr(x, y) -> Column:
    """The place of y in x, 0 if there is none or if either is NULL."""
    return F.coalesce(F.call_function("instr", _column(x), _column(y)), F.lit(0)).cast("long")


def replace(x, y, z) -> Column:
    """NULL y leaves x; NULL z removes; an empty y leaves x."""
    x, y = _column(x), _column(y)
    return F.when(y.isNull(), x).otherwise(F.replace(x, y, F.coalesce(_column(z), F.lit(""))))


def trim_chars(s, chars: str = " ", side: str = "both") -> Column:
    """Removes any of ``chars`` from the beginning, the end or both."""
    name = {"both": "btrim", "leading": "ltrim", "trailing": "rtrim"}[side]
    return F.call_function("btrim", _column(s), F.lit(chars)) if name == "btrim" else getattr(F, name)(_column(s), F.lit(chars))


def concat(*parts) -> Column:
    """NULL if any part is."""
    return F.concat(*(_column(p).cast("string") for p in parts))


def concat_ws(separator: str, *parts) -> Column:
    """Skips NULLs."""
    return F.concat_ws(separator, *(_column(p).cast("string") for p in parts))


def format_text(pattern: str, *values) -> Column:
    """printf verbs; %v stands for any value as text, %q for a quoted one."""
    verbs = re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?[a-zA-Z%]", pattern)
    columns, k = [], 0
    for verb in verbs:
        if verb[-1] == "%":
            continue
        value = _column(values[k])
        columns.append(F.concat(F.lit('"'), value.cast("string"), F.lit('"')) if verb[-1] == "q" else value.cast("string") if verb[-1] in "vs" else value)
        k += 1
    plain = re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)[vq]", r"\1s", pattern)
    return F.format_string(plain, *columns)


def char_of(*points) -> Column:
    """The characters of code points; NULL if any is."""
    return F.concat(*(F.decode(F.unhex(F.lpad(F.hex(_column(p).cast("long")), 8, "0")), "UTF-32") for p in points))


def unicode_of(s) -> Column:
    """The first code point, 0 for the empty string."""
    return F.ascii(_column(s)).cast("long")


def hex_text(x) -> Column:
    """Hexadecimal digits of the text form."""
    return F.hex(_column(x).cast("string"))


def unhex(s) -> Column:
    """NULL for an odd number of digits or for anything but digits; surrounding blanks don't count."""
    s = F.trim(_column(s))
    return F.when(s.rlike(r"^([0-9A-Fa-f]{2})*$"), F.unhex(s))


def quote(x) -> Column:
    """A SQL literal: text in quotes, NULL as the word."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(_column(x).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def soundex(s) -> Column:
    """'?000' for a text without letters."""
    letters = F.regexp_replace(F.coalesce(_column(s), F.lit("")), "[^A-Za-z]", "")
    return F.when(letters == "", F.lit("?000")).otherwise(F.soundex(letters))


def glob_pattern(pattern: str) -> str:
    """A regular expression for a pattern of ``*``, ``?`` and ``[...]`` (``[^...]`` or ``[!...]`` negated)."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end]
            negated = inner[0] in "^!"
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]&])", r"\\\1", inner[negated:]) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def glob(pattern: str, s) -> Column:
    """Whether the text matches the pattern."""
    return _column(s).rlike(glob_pattern(pattern))


_ESCAPES = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([nrt\\]))")
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}


def _escape(m: re.Match) -> str:
    digits = m[1] or m[2] or m[3]
    if digits:
        point = int(digits, 16)
        return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else m[0]
    return _PLAIN[m[4]]


def expand_escapes(column: pd.Series) -> pd.Series:
    return column.map(lambda x: _ESCAPES.sub(_escape, x), na_action="ignore")


def unistr(s) -> Column:
    r"""Expands \uXXXX, \UXXXXXXXX, \+XXXXXX, \n, \r, \t and \\; other text stays."""
    return F.pandas_udf(expand_escapes, "string")(_column(s))


def zero_blob(n: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def random_blob(n: int) -> Column:
    """n random bytes."""
    return F.unhex(F.substr(F.concat(*(F.lpad(F.hex((F.rand() * F.lit(2.0**32)).cast("long")), 8, "0") for _ in range(max(1, -(-n // 4))))), F.lit(1), F.lit(2 * n)))
