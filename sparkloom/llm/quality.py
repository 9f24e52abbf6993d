"""Quality classifier: a byte-level convolutional network in numpy.

Every byte position of a text is looked at by ``FILTERS`` learned filters of
``WIDTH`` bytes. The responses are max-pooled over overlapping chunks of two
blocks of ``BLOCK`` positions, one chunk per block, which cover the whole text; the
pooled responses of the chunks are combined by their mean and by their maximum, and
a logistic layer makes one probability of both.

The filters see one-hot bytes, so a filter is a table of weights by place and byte.
For scoring, the tables of adjacent places are joined (``compiled``), which halves
the lookups. Training is mini-batch AdaGrad; since only the position of a maximum
passes a gradient on, updates are sparse.

The network is fitted on at most ``SAMPLE`` labelled rows (those of the smallest
hashes of doc_id), on their whole texts. Null texts are scored as empty texts; an
empty text is one position of zero bytes. If no labelled row is available, every
score is 0.5. Rows with null labels are not learned from; a doc_id labelled twice
counts with each label. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

WIDTH = 8
FILTERS = 16
BLOCK = 256
#: Most labelled rows to learn from.
SAMPLE = 5000
EPOCHS = 6
BATCH = 16
RATE = 0.05
KEEP = 0.3


class Network:
    def __init__(self, seed: int = 7):
        noise = np.random.default_rng(seed)
        self.filters = noise.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, dtype=np.float32)
        self.weights = noise.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = 0.0
        self._pairs: list[np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_pairs": None}

    def compiled(self) -> list[np.ndarray]:
        """Weights by two adjacent bytes, for every second place."""
        if self._pairs is None:
            pair = lambda k: (self.filters[k][:, None, :] + self.filters[k + 1][None, :, :]).reshape(1 << 16, FILTERS)
            self._pairs = [np.ascontiguousarray(pair(k)) for k in range(0, WIDTH, 2)]
        return self._pairs

    def responses(self, padded: np.ndarray, places: np.ndarray, trained: bool) -> np.ndarray:
        """Filter responses at the given places of the padded bytes."""
        if trained:
            two = padded[:-1].astype(np.int32) << 8 | padded[1:]
            tables, step = self.compiled(), 2
        else:
            two, tables, step = padded, list(self.filters), 1
        out = np.take(tables[0], two[places], axis=0)
        for k, table in enumerate(tables[1:], 1):
            out += np.take(table, two[places + step * k], axis=0)
        return out

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The probability of each row; chunks are pooled in pieces of bounded size."""
        padded, places, blocks, first = layout(raw, offs)
        pooled = np.empty((len(blocks) - 1, FILTERS), dtype=np.float32)
        step = 256
        for a in range(0, len(pooled), step):
            b = min(len(pooled), a + step)
            part = self.responses(padded, places[blocks[a] : blocks[b]], True)
            pooled[a:b] = np.maximum.reduceat(part, blocks[a:b] - blocks[a], axis=0)
        features, _ = combine(np.maximum(pooled + self.offset, 0), first)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30).astype(np.float64)))


def layout(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes, the places of all rows, the first place of each block, and the first block of each row.

    Every row has WIDTH zero bytes after it, so filters see no other row.
    """
    sizes = np.diff(offs)
    shift = np.arange(len(sizes)) * WIDTH
    padded = np.zeros(len(raw) + (len(sizes) + 1) * WIDTH, dtype=np.uint8)
    padded[np.arange(len(raw)) + np.repeat(shift, sizes)] = raw
    count = np.maximum(sizes, 1)
    begins = offs[:-1] + shift
    places = K.expand(begins, count)
    per_row = -(-count // BLOCK)
    first = np.append(0, np.cumsum(per_row))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], per_row)
    blocks = np.append(np.repeat(np.cumsum(count) - count, per_row) + inner * BLOCK, count.sum())
    return padded, places, blocks, first


def combine(pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Mean and maximum over the chunks of each row; a chunk is a block and the next one of its row."""
    after = np.arange(1, len(pooled) + 1)
    after[first[1:] - 1] -= 1
    chunks = np.maximum(pooled, pooled[after])
    counts = np.diff(first)[:, None].astype(np.float32)
    mean = np.add.reduceat(chunks, first[:-1], axis=0) / counts
    return np.hstack([mean, np.maximum.reduceat(chunks, first[:-1], axis=0)]), (chunks, after)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Learns from whole texts; label 1 is the probable class of a high score."""
    net, order = Network(seed), np.random.default_rng(seed)
    sums = [np.full_like(net.filters, 1e-6), np.full_like(net.offset, 1e-6), np.full_like(net.weights, 1e-6)]
    bias_sum = 1e-6
    if not len(texts):
        net.weights[:] = 0
        return net
    share = np.clip(labels.mean(), 0.01, 0.99)
    net.bias = float(np.log(share / (1 - share)))
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        for part in np.array_split(order.permutation(len(texts)), -(-len(texts) // BATCH)):
            raw = np.frombuffer(b"".join(texts[i] for i in part), dtype=np.uint8)
            offs = np.append(0, np.cumsum([len(texts[i]) for i in part]))
            padded, places, blocks, first = layout(raw, offs)
            values = net.responses(padded, places, False)
            pooled = np.maximum.reduceat(values, blocks[:-1], axis=0)
            active = np.maximum(pooled + net.offset, 0)
            features, (chunks, after) = combine(active, first)
            out = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.bias, -30, 30)))
            error = (out - labels[part]).astype(np.float32) / len(part)
            # back through the combination to the blocks that gave each chunk its value
            counts = np.diff(first)
            row = np.repeat(np.arange(len(counts)), counts)
            to_chunk = error[row, None] * net.weights[:FILTERS] / counts[row, None]
            best = features[:, FILTERS:][row]
            is_best = (chunks == best) & (chunks > 0)
            ties = np.maximum(np.add.reduceat(is_best.astype(np.float32), first[:-1], axis=0), 1)
            to_chunk += is_best * error[row, None] * net.weights[FILTERS:] / ties[row]
            own = active == chunks
            to_block = np.where(own, to_chunk, 0)
            np.add.at(to_block, after, np.where(own, 0, to_chunk))
            to_block *= active > 0
            # and to the position of each block's maximum
            block, which = np.nonzero(to_block)
            gradient = to_block[block, which]
            at = np.empty(len(block), dtype=np.int64)
            position = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks))
            hit = values == pooled[position]
            for f in range(FILTERS):
                mine = which == f
                rows = np.flatnonzero(hit[:, f])
                _, one = np.unique(position[rows], return_index=True)
                at[mine] = places[rows[one]][block[mine]]
            grads = [np.zeros_like(net.filters), np.zeros_like(net.offset), error @ features]
            np.add.at(grads[1], which, gradient)
            for k in range(WIDTH):
                np.add.at(grads[0], (k, padded[at + k], which), gradient)
            for value, g, total in zip((net.filters, net.offset, net.weights), grads, sums, strict=True):
                total += g * g
                value -= rate * g / np.sqrt(total)
            bias_sum += float(error.sum()) ** 2
            net.bias -= rate * float(error.sum()) / bias_sum**0.5
    net._pairs = None
    return net


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE) -> Network:
    """Fits on at most ``sample`` labelled documents among those for which ``learn`` (a condition on doc_id) holds.

    A document with several labels counts as the least of them. An executor does the fitting (``common.learned``).
    """

    def fitted(rows: pa.Table) -> Network:
        rows = rows.sort_by([("doc_id", "ascending")])
        return fit([x.as_py() for x in rows.column("data")], np.array(rows.column("quality").to_pylist(), dtype=np.float32))

    known = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).join(F.broadcast(chosen), "doc_id")
    return common.learned(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "data").limit(sample), fitted)  # a doc_id may repeat


def _scores(net: Network, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(net.score(raw, offs) for _, _, raw, offs in K.slices(column))])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and the score of each text."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores at least ``keep``."""
    model, text = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(text)) >= keep))

    return docs.mapInArrow(run, docs.schema)
