"""Table definitions and their constraints, checked a batch at a time."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintViolation, NotFound, TypeMismatch


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str


@dataclass
class Column:
    name: str
    kind: str = "string"
    not_null: bool = False
    default: str | None = None  #: SQL text
    generated: str | None = None  #: SQL text over the other columns
    stored: bool = True


@dataclass
class Table:
    name: str
    columns: list[Column]
    key: str | None = None
    unique: list[tuple[str, ...]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    rows: DataFrame | None = None  #: the current version
    parts: list[str] = field(default_factory=list)  #: its folders, if this session has written all of it
    fresh: bool = False  #: made by this session, so that parts are all of it

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise NotFound(f"{self.name} has no column {name}")

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {c.kind}" for c in self.columns)

    def completed(self, rows: DataFrame, given: list[str]) -> DataFrame:
        """Rows of the given columns with defaults for omitted columns, cast, and generated columns computed."""
        given = [self.column(g).name for g in given]
        for g in given:
            if self.column(g).generated:
                raise ConstraintViolation("GENERATED", f"{g} can't be given")
        values = {g: F.col(f"`{c}`") for g, c in zip(given, rows.columns, strict=True)}
        plain = [c for c in self.columns if not c.generated]
        try:
            out = rows.select(*[values.get(c.name, F.expr(c.default) if c.default is not None else F.lit(None)).cast(c.kind).alias(c.name) for c in plain])
        except Exception as e:
            raise TypeMismatch(str(e)) from e
        return self.with_generated(out)

    def with_generated(self, rows: DataFrame) -> DataFrame:
        for c in self.columns:
            if c.generated:
                rows = rows.withColumn(c.name, F.expr(c.generated).cast(c.kind))
        return rows.select(*[f"`{c}`" for c in self.names])

    def violations(self, rows: DataFrame, tables: dict[str, Table], added: bool = False) -> dict[str, DataFrame]:
        """By kind of constraint, the rows (or keys) that break it. ``rows`` is the table as it would be.

        With ``added``, rows are what a statement adds to the current version, which holds already: only
        they are checked, and their keys are looked up in the version.
        """
        out = {}
        needed = [c.name for c in self.columns if c.not_null or c.name == self.key]
        for c in needed:
            out[f"NOT NULL {c}"] = rows.filter(F.col(f"`{c}`").isNull())
        for keys in ([(self.key,)] if self.key else []) + self.unique:
            given = rows
            for k in keys:
                given = given.filter(F.col(f"`{k}`").isNotNull())  # NULLs are all different
            twice = given.groupBy(*[f"`{k}`" for k in keys]).count().filter("count > 1")
            if added:
                known = self.rows.select(*[f"`{k}`" for k in keys])
                twice = twice.unionByName(given.join(known, list(keys), "left_semi").select(*[f"`{k}`" for k in keys], F.lit(2).cast("long").alias("count")))
            out[f"UNIQUE {', '.join(keys)}"] = twice
        for check in self.checks:
            out[f"CHECK {check}"] = rows.filter(~F.coalesce(F.expr(check), F.lit(True)))
        for f in self.foreign:
            target = tables[f.table.lower()].rows
            if added and f.table.lower() == self.name.lower():
                target = target.unionByName(rows)
            target = target.select(F.col(f"`{f.target}`").alias("_target"))
            out[f"FOREIGN KEY {f.column}"] = rows.filter(F.col(f"`{f.column}`").isNotNull()).join(target, F.col(f"`{f.column}`") == F.col("_target"), "left_anti")
        return out

    def copy(self) -> Table:
        """The definition and version, apart from later changes."""
        return replace(self, columns=[replace(c) for c in self.columns], unique=list(self.unique), checks=list(self.checks), foreign=list(self.foreign), parts=list(self.parts))

    def validate(self, rows: DataFrame, tables: dict[str, Table], added: bool = False) -> None:
        for kind, bad in self.violations(rows, tables, added).items():
            found = bad.limit(1).collect()
            if found:
                raise ConstraintViolation(kind, f"{self.name}: {found[0].asDict()}")
