"""JSON held as text; paths are dotted names and array places, as in ``a.b.0``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _path(path: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)


def json_extract(j, path: str) -> Column:
    """The value as text: a scalar's own text, JSON for arrays and objects; NULL if missing."""
    return F.get_json_object(_column(j), _path(path))


def json_valid(j) -> Column:
    """1 for JSON, else 0."""
    return F.when(F.try_parse_json(_column(j)).isNotNull(), 1).otherwise(0).cast("long")


def json_type(j) -> Column:
    """null, integer (for booleans), real, text, array or object; NULL for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(_column(j)))
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "integer")
        .when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "real")
        .when(kind == "STRING", "text")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT") | kind.startswith("STRUCT"), "object")
    )


def json_array(*values) -> Column:
    """Elements keep their JSON form whatever their types."""
    items = [F.coalesce(F.regexp_extract(F.to_json(F.struct(_column(v).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")) for v in values]
    return F.concat(F.lit("["), F.array_join(F.array(*[F.when(i == "", "null").otherwise(i) for i in items]), ",") if items else F.lit(""), F.lit("]"))


def json_object(**members) -> Column:
    """Members in the order of their names; NULL members are left as null."""
    return F.to_json(F.struct(*[_column(members[k]).alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})


def _put(text: str | None, path: str | None, new: str | None) -> str | None:
    """One JSON text with a member set; ``new`` is JSON with the value as member v."""
    try:
        top = json.loads(text)
    except (TypeError, ValueError):
        return None
    if path is None:
        return None
    steps = [int(p) if p.isdigit() else p for p in path.split(".") if p]
    value, at = json.loads(new)["v"] if new else None, top
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        if isinstance(at, list):
            if not isinstance(step, int) or step >= len(at):
                return text
            if last:
                at[step] = value
            at = at[step]
        elif isinstance(at, dict):
            step = str(step)
            if last:
                at[step] = value
            elif not isinstance(at.get(step), (dict, list)):
                at[step] = {}
            at = at[step]
        else:
            return text
    return json.dumps(top, separators=(",", ":"), ensure_ascii=False)


def set_members(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    given = lambda x: None if x is None or isinstance(x, float) else x
    return pd.Series([_put(given(t), given(p), given(v)) for t, p, v in zip(texts, paths, values, strict=True)], dtype="object")


def json_set(j, path: str, value) -> Column:
    """Sets one member, making objects on the way; an array place must exist. NULL for what is no JSON."""
    return F.pandas_udf(set_members, "string")(_column(j), F.lit(path), F.to_json(F.struct(_column(value).alias("v")), {"ignoreNullFields": "false"}))
