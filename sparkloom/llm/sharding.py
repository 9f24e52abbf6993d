"""Minimax contiguous sharding of documents by bytes.

Rows of equal text are one atomic group. Groups are ordered by their first doc_id;
the shards are runs of this order such that the largest shard is as small as any
such partition allows. The capacity is found by binary search; a capacity is
checked greedily, each shard taking as many whole groups as fit.

The driver sees summaries only: the bytes of each range partition, then of each block
of ``BLOCK`` groups in the few partitions where a cut may fall, then the groups of the
few blocks where a cut may fall. On each level a lower and an upper bound of every
cut follow from what is known (``bounds``), so what is read next is a matter of the
number of shards, not of the number of groups.

Null texts are one group, apart from empty texts. Null doc_ids come first. Repeated
rows are of one group and get a slot each. Further columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Groups of a block.
BLOCK = 4096

_FIRST = -(2**63)


class Segments:
    """Consecutive segments of the ordered groups: end positions in bytes, and whether each is a single group."""

    def __init__(self, sizes: np.ndarray, atomic: np.ndarray, names: list):
        self.ends, self.atomic, self.names = np.cumsum(sizes), atomic, names

    def reach(self, start: int, capacity: int) -> tuple[int, int]:
        """The least and the greatest possible end of a greedy shard that begins at ``start``."""
        goal = start + capacity
        k = int(np.searchsorted(self.ends, goal, side="right"))
        least = max(start, int(self.ends[k - 1])) if k else start
        if k == len(self.ends):
            return int(self.ends[-1]), int(self.ends[-1])
        return least, least if self.atomic[k] else goal

    def cuts(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """The ends of the greedy shards, by the greatest or the least ends."""
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity)[upper]
            out.append(at)
        return out

    def bounds(self, shards: int, least: int) -> tuple[int, int]:
        """The smallest capacity that may be feasible, and the smallest that surely is."""
        total = int(self.ends[-1])
        low = _smallest(lambda c: self.cuts(c, shards, True)[-1] >= total, max(least, -(-total // shards)), total)
        return low, _smallest(lambda c: self.cuts(c, shards, False)[-1] >= total, low, total)

    def unsure(self, shards: int, low: int, high: int) -> np.ndarray:
        """The segments, not single groups, in which a cut may fall for a capacity from ``low`` to ``high``."""
        out = np.zeros(len(self.ends), dtype=bool)
        for a, b in zip(self.cuts(low, shards, False), self.cuts(high, shards, True), strict=True):
            first, last = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, b, side="right")
            out[first : last + 1] = True
        return np.flatnonzero(out & ~self.atomic)


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    """The smallest feasible integer from ``low`` to ``high``; ``high`` is feasible."""
    while low < high:
        middle = (low + high) // 2
        if feasible(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The least capacity and the end position of each shard, for group sizes in memory."""
    known = Segments(sizes, np.ones(len(sizes), dtype=bool), list(range(len(sizes))))
    capacity = known.bounds(shards, int(sizes.max()))[1]
    return capacity, known.cuts(capacity, shards, False)


def _numbered(names: list[str], within: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the task's partition and the row's place in it (of the same value of ``within``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            n = batch.num_rows
            values = batch.column(names.index(within)).to_numpy() if within else np.zeros(n, np.int64)
            place = np.zeros(n, np.int64)
            for value in np.unique(values):
                rows = np.flatnonzero(values == value)
                place[rows] = seen.get(int(value), 0) + np.arange(len(rows))
                seen[int(value)] = seen.get(int(value), 0) + len(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place)], names=[*names, "part", "place"])

    return run


def _cuts(groups: DataFrame, shards: int) -> tuple[list[int], dict[int, int]]:
    """The end position of each shard, and the position at which each range partition begins."""
    rows = groups.groupBy("part").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("bytes").alias("m")).orderBy("part").collect()
    sizes, counts = [r["b"] for r in rows], [r["n"] for r in rows]
    begins = dict(zip([r["part"] for r in rows], np.cumsum([0, *sizes[:-1]]).tolist(), strict=True))
    least = max(r["m"] for r in rows)
    known = Segments(np.array(sizes), np.array(counts) == 1, [(r["part"], None) for r in rows])
    while True:
        low, high = known.bounds(shards, least)
        unsure = known.unsure(shards, low, high)
        if not len(unsure):
            return known.cuts(high, shards, False), begins
        parts = [known.names[k][0] for k in unsure if known.names[k][1] is None]
        blocks = [known.names[k] for k in unsure if known.names[k][1] is not None]
        finer: dict[tuple, list] = {}
        if parts:
            for r in groups.filter(F.col("part").isin(parts)).groupBy("part", "block").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).orderBy("part", "block").collect():
                finer.setdefault((r["part"], None), []).append((r["b"], r["n"] == 1, (r["part"], r["block"])))
        if blocks:
            chosen = F.struct("part", "block").isin([F.struct(F.lit(p).cast("long"), F.lit(b).cast("long")) for p, b in blocks])
            for r in groups.filter(F.col("part").isin([p for p, _ in blocks])).filter(chosen).orderBy("part", "place").select("part", "block", "bytes").toLocalIterator():
                finer.setdefault((r["part"], r["block"]), []).append((r["bytes"], True, (r["part"], r["block"])))
        sizes = np.diff(known.ends, prepend=0)
        flat = [x for k, name in enumerate(known.names) for x in ([(int(sizes[k]), True, name)] if known.atomic[k] else finer.get(name) or [(int(sizes[k]), False, name)])]
        known = Segments(np.array([x[0] for x in flat]), np.array([x[1] for x in flat]), [x[2] for x in flat])


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every row.

    Slots number a shard's rows from 0 in the order of groups, then of doc_ids.
    """
    spark = docs.sparkSession
    data = F.col("text").cast("binary")
    sizes = common.materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(data, 256)), F.lit(b"")).alias("key"),
        ),
        "sizes",
    )
    n = common.partitions(spark)
    first = F.coalesce(F.min("doc_id"), F.lit(_FIRST)).alias("first")
    names = ["first", "key", "bytes"]
    groups = (
        sizes.groupBy("key")
        .agg(first, F.sum("size").alias("bytes"))
        .select(*names)
        .repartitionByRange(n, "first", "key")
        .sortWithinPartitions("first", "key")
        .mapInArrow(_numbered(names, None), "first long, key binary, bytes long, part long, place long")
    )
    groups = common.materialize(groups.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long")), "groups")
    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if groups.isEmpty():
        return spark.createDataFrame([], schema)
    ends, begins = _cuts(groups, shards)
    starts = spark.createDataFrame(list(begins.items()), "part long, begin long")
    inner = Window.partitionBy("part").orderBy("place")
    end = F.sum("bytes").over(inner) + F.col("begin")
    shard = sum((F.when(F.col("end") > F.lit(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    placed = groups.join(F.broadcast(starts), "part").withColumn("end", end).select("key", "first", shard.alias("shard"))
    columns = ["doc_id", "size", "text_crc32", "first", "shard"]
    order = ("shard", "first", "key", F.col("doc_id").asc_nulls_first())
    rows = (
        sizes.join(placed.hint("merge"), "key")
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(*columns)
        .mapInArrow(_numbered(columns, "shard"), "doc_id long, size long, text_crc32 long, first long, shard int, part long, place long")
    )
    rows = common.materialize(rows, "slots")
    # a row for each shard and partition: small
    runs = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    runs = runs.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(runs), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, assigned: DataFrame, folder: str) -> None:
    """Writes the documents to one folder per shard, ordered by slot within each file. Needs unique doc_ids."""
    rows = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange(common.partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
