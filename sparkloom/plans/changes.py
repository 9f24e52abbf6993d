"""Changes to tables: each gives the table's next version, and the rows it has touched.

Rows are immutable, so a change is a query over the version before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


_PLACE = "_place"


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the statement."""
    return rows.withColumn(_PLACE, F.monotonically_increasing_id())


def _whole(keys) -> Column:
    """Whether a key has no NULL; a key with one conflicts with none."""
    return functools.reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys))


def _one_of_key(rows: DataFrame, keys, last: bool) -> DataFrame:
    """Of placed rows with the same key the first or the last."""
    pick = F.max_by if last else F.min_by
    whole = rows.filter(_whole(keys)).groupBy(*(F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys))).agg(pick(F.struct(*rows.columns), _PLACE).alias("_row")).select("_row.*")
    return whole.unionByName(rows.filter(~_whole(keys)))


def _without(rows: DataFrame, others: DataFrame, keys) -> DataFrame:
    """Rows whose key is not among others."""
    seen = others.select(*(F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)))
    on = functools.reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"_key{n}") for n, k in enumerate(keys)))
    return rows.join(seen, on, "left_anti")


def _sets(keys) -> list[tuple[str, ...]]:
    """One key (a list of columns) or several."""
    return [tuple(keys)] if keys and isinstance(keys[0], str) else [tuple(k) for k in keys]


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO NOTHING: a row with a key that is there already, or came before it, is skipped.

    ``keys`` is a list of columns or of such lists. With several, a row that one of them
    refuses doesn't stand in the way of later rows, so rows enter in rounds.
    """
    sets, columns = _sets(keys), table.columns
    left = _placed(rows)
    for k in sets:
        left = _without(left, table, k)
    if len(sets) == 1:
        fresh = _one_of_key(left, sets[0], False).select(*columns)
        return table.unionByName(fresh), fresh
    fresh = None
    while True:
        left = left.persist()
        first = left
        for k in sets:
            whole = F.when(_whole(k), F.lit(0)).otherwise(F.col(_PLACE) + 1)
            own = Window.partitionBy(*(F.col(f"`{c}`") for c in k), whole)
            first = first.withColumn("_first", F.min(_PLACE).over(own)).filter(F.col("_first") == F.col(_PLACE)).drop("_first")
        if first.isEmpty():
            break
        fresh = first if fresh is None else fresh.unionByName(first)
        rest = _without(left, first.select(F.col(_PLACE)), [_PLACE])
        for k in sets:
            rest = _without(rest, first, k)
        left = rest
    fresh = rows.limit(0) if fresh is None else fresh
    fresh = fresh.select(*columns)
    return table.unionByName(fresh), fresh


def insert_or_replace(table: DataFrame, rows: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """Rows take the place of those with their key, and later rows that of earlier ones; by every key."""
    placed, columns = _placed(rows), table.columns
    kept = placed
    for k in _sets(keys):
        table = _without(table, rows, k)
        last = placed.filter(_whole(k)).groupBy(*(F.col(f"`{c}`").alias(f"_key{n}") for n, c in enumerate(k))).agg(F.max(_PLACE).alias("_last"))
        gone = functools.reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"_key{n}") for n, c in enumerate(k))) & (F.col(_PLACE) < F.col("_last"))
        kept = kept.join(last, gone, "left_anti")
    kept = kept.select(*columns)
    return table.unionByName(kept), kept


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], assignments: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO UPDATE: one join of both; assignments may use the row's columns and ``excluded.<column>``.

    Of several new rows with one key the last one counts. Keys with a NULL conflict with none.
    """
    rows = _one_of_key(_placed(rows), keys, True).drop(_PLACE)
    old = table.select("*", F.lit(True).alias("_old")).alias("target")
    new = rows.select("*", F.lit(True).alias("_new")).alias("excluded")
    on = [F.col(f"target.{k}") == F.col(f"excluded.{k}") for k in keys]
    both = old.join(new, on, "full")
    hit = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    given = {k.lower(): v for k, v in assignments.items()}

    def value(c: str) -> Column:
        kept = F.when(F.col("_old").isNull(), F.col(f"excluded.{c}"))
        if c.lower() in given:
            changed = F.expr(_qualified(given[c.lower()], table.columns)).cast(dict(table.dtypes)[c])
            kept = kept.when(hit, changed)
        return kept.otherwise(F.col(f"target.{c}")).alias(c)

    result = both.select(*[value(c) for c in table.columns], F.col("_new").alias("_touched"))
    return result.drop("_touched"), result.filter("_touched").drop("_touched")


def _qualified(text: str, columns: list[str]) -> str:
    """Bare column names of an assignment mean the row that is there."""
    import re

    names = {c.lower() for c in columns}

    def one(m: re.Match) -> str:
        return f"target.{m[0]}" if m[0].lower() in names else m[0]

    return "".join(part if k % 2 else re.sub(r"(?<![\w.'])[A-Za-z_]\w*(?![\w(.'])", one, part) for k, part in enumerate(re.split(r"('(?:[^']|'')*')", text)))


def update(table: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """All assignments see the row as it was; rows for which the condition is NULL stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    given = {k.lower(): v for k, v in assignments.items()}
    kinds = dict(table.dtypes)
    marked = table.select("*", hit.alias("_hit"))
    columns = [F.when(F.col("_hit"), given[c.lower()].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c.lower() in given else F.col(c) for c in table.columns]
    result = marked.select(*columns, "_hit")
    return result.drop("_hit"), result.filter("_hit").drop("_hit")


def delete(table: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return table.filter(~hit), table.filter(hit)
