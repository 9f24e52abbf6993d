"""Tables in files: lazily read, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: File formats that Spark brings along, and options that make them read as they were written.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true", "escape": '"', "nullValue": "\\N"}, "text": {}}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table from files; formats without a schema of their own should be given one.

    ``jdbc`` takes url and dbtable as options, and needs the driver on the class path.
    """
    reader = spark.read.format(fmt).options(**{**FORMATS.get(fmt, {}), **options})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load() if fmt == "jdbc" else reader.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**{**FORMATS.get(fmt, {}), **options})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        return read_table(self._spark, f"{self._folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Makes temporary views of the tables of a folder."""
    for name in names:
        read_table(spark, f"{folder}/{name}.parquet").createOrReplaceTempView(name)
