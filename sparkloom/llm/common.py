"""What the corpus operators share: inputs, shared storage and bounded broadcasts."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_written: list[str] = []


def text_batches(spark: SparkSession) -> None:
    """Python workers get texts in small Arrow batches, so that a worker's memory is that of a few slices.

    The setting is read when a query runs, so it stays in the session; a smaller one of the session's is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 1000:
        spark.conf.set(name, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _own_folder[0]


def materialize(df: DataFrame, name: str = "step", options: dict | None = None, **measures) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage, so a lost executor costs no recomputation of what came
    before, and what depends on the order or placement of rows is fixed from here
    on. ``release`` deletes what a session has written. The number of rows and the
    values of further aggregates are taken on the way (``measured``).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(value.alias(key) for key, value in measures.items())).write.options(**(options or {})).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.measured = seen.get
    return out


def is_empty(df: DataFrame) -> bool:
    """Whether a frame has no rows; of a materialized one this is known."""
    measured = getattr(df, "measured", {})
    return not measured["rows"] if "rows" in measured else df.isEmpty()


def release(spark: SparkSession) -> None:
    """Deletes the folders written by ``materialize``; frames read from them end with it."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = 200_000) -> DataFrame:
    """A join whose right side is broadcast if it has at most ``rows`` rows, and shuffled otherwise.

    ``right`` should be cheap to count (a materialized frame).
    """
    measured = getattr(right, "measured", {})
    if (measured["rows"] if "rows" in measured else right.limit(rows + 1).count()) <= rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def learned(rows: DataFrame, fit: Callable):
    """What ``fit`` makes of the table of all rows, in their order; ``rows`` must be of bounded size.

    One task of an executor learns, so the driver holds neither the rows nor what learning takes of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    model = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model["model"]) if model else fit(rows.limit(0).toArrow())


def crc_remainder(column: str, modulus: int):
    """crc32 of the column's text form, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
