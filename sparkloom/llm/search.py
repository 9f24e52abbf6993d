"""Exact top-k search by term-at-a-time accumulation.

A vector is a sparse row of integer weights by dimension (its terms). A block of
candidates is an inverted file: for each term the postings (candidate, weight). The
queries of a block go through their terms one at a time and scatter
query weight x posting weight into dense score arrays, one array of a block's
candidates per query; then each array is partitioned for its k best, and the best of
all blocks are merged.

Queries and candidates meet in a grid of blocks: a candidate goes to one block per
query block, a query to one block per candidate block. Block sizes are fixed, so a
task's memory doesn't depend on the input, and rows are dealt by a hash of the whole
row's id, so equal vectors don't meet in one block. Exhaustive search of a query set
that grows with the table takes work in proportion to their product.

Vectors that are null or hold null or non-finite components take no part; rows with a
null id neither. Empty vectors score 0. Components beyond +-2**53 after scaling count
as +-2**53, and scores beyond 64 bits as the greatest or least long (less 1). Vectors
of unequal length are compared over the shorter (missing components are 0). Rows that
repeat an id are candidates each, and queries each; a query excludes all rows of its
own id. Rows that repeat an id with the same vector are scored once and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block.
CANDIDATES = 1 << 13
QUERIES = 1 << 11
#: Scores held at once: so many queries of a block are taken together.
CELLS = 1 << 22


def quantised(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id and the weights floor(scale * x) as an array of longs, of rows that take part."""
    x = F.col(vector).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    weight = lambda v: F.floor(F.greatest(F.lit(-(2.0**53)), F.least(F.lit(2.0**53), v * F.lit(scale)))).cast("long")
    return df.filter(F.col(vec_id).isNotNull() & x.isNotNull()).filter(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, weight).alias("weights"))


class Postings:
    """The inverted file of a block of candidate vectors."""

    def __init__(self, weights: np.ndarray):
        self.size, self.terms = weights.shape
        term, candidate = np.nonzero(weights.T)
        self._cuts = np.searchsorted(term, np.arange(self.terms + 1))
        self._candidates, self._weights = candidate, weights[candidate, term]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Dense scores of each query against all candidates, accumulated term by term."""
        # beyond 64 bits, exact integers are summed and then held to the range of a long
        wide = self.terms * float(np.abs(queries).max(initial=0)) * float(np.abs(self._weights).max(initial=0)) >= 2.0**62
        kind = object if wide else np.int64
        queries, weights = queries.astype(kind), self._weights.astype(kind)
        out = np.zeros((len(queries), self.size), dtype=kind)
        for term in range(min(self.terms, queries.shape[1])):
            a, b = self._cuts[term], self._cuts[term + 1]
            with_term = np.flatnonzero(queries[:, term])
            if a == b or not len(with_term):
                continue
            added = queries[with_term, term][:, None] * weights[None, a:b]
            if len(with_term) == len(queries) and b - a == self.size:
                out += added
            else:
                out[np.ix_(with_term, self._candidates[a:b])] += added
        return np.clip(out, 1 - 2**63 + 1, 2**63 - 2).astype(np.int64) if wide else out


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate) of each query's k best scores. Candidates ascend by id, so ties go to the smaller."""
    lowest = np.iinfo(np.int64).min
    scores = np.where(ids[None, :] == own[:, None], lowest, scores)
    n = scores.shape[1]
    if n <= k:
        row, candidate = np.nonzero(scores > lowest)
        return row, candidate
    threshold = np.partition(scores, n - k, axis=1)[:, n - k]
    over = scores > threshold[:, None]
    ties = (scores == threshold[:, None]) & (threshold > lowest)[:, None]
    room = k - over.sum(axis=1)
    row, candidate = np.nonzero(ties)
    begins = np.searchsorted(row, np.arange(len(scores)))
    early = np.arange(len(row)) - begins[row] < room[row]
    more = np.nonzero(over)
    return np.concatenate([more[0], row[early]]), np.concatenate([more[1], candidate[early]])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), int(lengths[0]))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest inner product for each query row.

    Both frames have vec_id and weights (see ``quantised``). Their rows are counted first.
    """
    same = ["vec_id", "weights"]
    vectors = vectors.groupBy(*same).agg(F.least(F.count("*"), F.lit(k)).alias("copies"))
    queries = queries.groupBy(*same).agg(F.count("*").alias("copies"))
    n, m = vectors.count(), queries.count()
    columns, lines = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    side = lambda is_query: F.lit(is_query).alias("is_query")
    dealt = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    candidates = vectors.select(side(False), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), F.pmod(F.xxhash64("vec_id", "weights"), F.lit(columns)).cast("int").alias("column"), *same, "copies", F.lit(0).cast("long").alias("ask"))
    asked = queries.select(side(True), dealt(lines).alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"), *same, "copies", F.xxhash64(*same).alias("ask"))

    names = ("query_id", "ask", "again", "vec_id", "score", "times")

    def block(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        ids, copies, ask = (table.column(c).to_numpy() for c in ("vec_id", "copies", "ask"))
        weights = _matrix(table.column("weights"))
        order = np.argsort(ids[~is_query], kind="stable")
        candidate_ids, times, postings = ids[~is_query][order], copies[~is_query][order], Postings(weights[~is_query][order])
        query_ids, asks, again, query_weights = ids[is_query], ask[is_query], copies[is_query], weights[is_query]
        out: list[list] = [[] for _ in names]
        step = max(1, CELLS // max(1, len(candidate_ids)))
        for a in range(0, len(query_ids) if len(candidate_ids) else 0, step):
            scores = postings.scores(query_weights[a : a + step])
            row, candidate = best(scores, candidate_ids, query_ids[a : a + step], k)
            for to, values in zip(out, (query_ids[a + row], asks[a + row], again[a + row], candidate_ids[candidate], scores[row, candidate], times[candidate]), strict=True):
                to.append(values)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(names, out, strict=True)})

    found = candidates.unionByName(asked).groupBy("line", "column").applyInArrow(block, ", ".join(f"{c} long" for c in names))
    each = lambda count: F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))
    found = found.withColumn("copy", each("times"))  # k at most
    ranked = Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return found.withColumn("asked", each("again")).select("query_id", "rank", "vec_id", "score")
