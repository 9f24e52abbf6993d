"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are the 1- to 3-grams of a text's lower-cased code points (runs of white
space count as one blank), hashed into ``BUCKETS``. A feature's value is its share of
the text's n-grams times its inverse document frequency; document frequencies come
from all texts that may be learned from. The weights are trained one text at a time
by follow-the-regularised-leader with an elastic net (L1 and L2), and the
probabilities are then calibrated by one temperature on texts kept from training.

The regression is fitted on at most ``SAMPLE`` labelled rows (those of the smallest
hashes of doc_id), on their whole texts. Prediction goes over whole texts of any
length: weights times inverse frequencies form one table, and a text's scores are
sums of its rows.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows are
predicted each. Rows with a null language are not learned from; if none is left,
everything is ``und``. Ties go to the first language in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as K

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Most labelled rows to learn from; each fifth of them calibrates.
SAMPLE = 4000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
#: Feature values are shares; this brings them to the order of 1.
SCALE = 100.0
UNKNOWN = "und"
#: A text of the pipeline is kept from this score; texts of two languages are not far above a third each.
KEEP = 0.3

_MULTIPLIERS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all rows, the rows' offsets into them, and whether each row has a letter."""
    raw, offs = K.buffers(pc.utf8_lower(column.fill_null("")))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.zeros(len(offs) - 1, bool)
    chars, begins = K.code_points(raw)
    rows = np.searchsorted(begins, offs)
    kind = K.char_classes()[chars]
    letters = np.append(0, np.cumsum(kind == K.LETTER))
    has_letter = letters[rows[1:]] > letters[rows[:-1]]
    blank = kind == K.SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    edge = rows[:-1][rows[:-1] < len(chars)]
    keep[edge] = True
    rows = np.append(0, np.cumsum(keep))[rows]
    chars = np.where(blank, np.uint32(32), chars)[keep]
    ends = np.repeat(rows[1:], np.diff(rows))
    at = np.arange(len(chars))
    found = np.full((len(chars), len(ORDERS)), -1, dtype=np.int32)
    rolled = np.zeros(len(chars), dtype=np.uint32)
    for k, n in enumerate(ORDERS):
        rolled[: len(chars) - n + 1] = rolled[: len(chars) - n + 1] * _MULTIPLIERS[1] + (chars[n - 1 :] + np.uint32(n)) * _MULTIPLIERS[2]
        hashed = (rolled ^ (rolled >> np.uint32(15))) * _MULTIPLIERS[0] >> np.uint32(16)
        whole = at + n <= ends
        found[whole, k] = hashed[whole]
    present = found >= 0
    counts = np.append(0, np.cumsum(present.sum(axis=1)))
    return found[present].astype(np.int64), counts[rows], has_letter


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        """weights: by feature and language, with the inverse document frequencies and SCALE in them."""
        self.languages, self.weights, self.bias, self.temperature = languages, weights.astype(np.float32), bias, temperature

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        features, first, has_letter = grams(column)
        out = np.tile(self.bias, (len(first) - 1, 1))
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        if len(full):
            sums = np.empty((len(full), len(self.languages)))
            for j in range(len(self.languages)):
                sums[:, j] = np.add.reduceat(self.weights[:, j][features], first[:-1][full], dtype=np.float64)
            out[full] += sums / sizes[full, None]
        return out, has_letter

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b, _, _ in K.slices(column):
            logits, has_letter = self.logits(column.slice(a, b - a))
            if not self.languages:
                names += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            p = softmax(logits / self.temperature)
            best = p.argmax(axis=1)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has_letter, strict=True)]
            scores.append(np.where(has_letter, p[np.arange(b - a), best], 0.0))
        return names, np.concatenate([np.zeros(0), *scores])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    classes = np.array([languages.index(x) for x in labels])
    rows = []
    for text in texts:
        features, _, _ = grams(pa.array([text]))
        used, counts = np.unique(features, return_counts=True)
        rows.append((used, SCALE * idf[used] * counts / max(1, len(features))))
    c = len(languages)
    z, n = np.zeros((BUCKETS, c)), np.zeros((BUCKETS, c))
    zb, nb = np.zeros(c), np.zeros(c)
    order = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    held = np.arange(len(texts)) % 5 == 4
    for _ in range(epochs):
        for i in order.permutation(np.flatnonzero(~held)):
            used, values = rows[i]
            w, wb = weights(z[used], n[used]), weights(zb, nb)
            error = softmax(values @ w + wb)
            error[classes[i]] -= 1
            for g, index, zz, nn, ww in ((values[:, None] * error, used, z, n, w), (error, slice(None), zb, nb, wb)):
                more = nn[index] + g * g
                zz[index] += g - (np.sqrt(more) - np.sqrt(nn[index])) / ALPHA * ww
                nn[index] = more
    w, wb = weights(z, n), weights(zb, nb)
    held = held if held.any() else ~held
    logits = np.array([rows[i][1] @ w[rows[i][0]] + wb for i in np.flatnonzero(held)])
    truth = classes[held]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return Model(languages, w * idf[:, None] * SCALE, wb, temperature)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many each feature occurs; counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for a, b, _, _ in K.slices(batch.column(0)):
                features, first, _ = grams(batch.column(0).slice(a, b - a))
                seen = np.zeros(BUCKETS, dtype=bool)
                for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if y - x > 4096:
                        seen[features[x:y]] = True
                        counts += seen
                        seen[features[x:y]] = False
                    else:
                        counts[np.unique(features[x:y])] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], total))], names=["feature", "n"])

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    feature, n = rows.column("feature").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(BUCKETS, np.int64)
    counts[feature[feature >= 0]] = n[feature >= 0]
    return int(n[feature < 0].sum()), counts


def train(docs: DataFrame, learn, sample: int = SAMPLE) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` holds and lang is given.

    An executor fits the regression (``common.learned``).
    """
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total, counts = document_frequencies(usable)
    idf = np.log((1 + total) / (1 + counts)) + 1
    order = (F.xxhash64("doc_id"), "doc_id", "lang")
    chosen = usable.select("doc_id", "lang").distinct().orderBy(*order).limit(sample).withColumnRenamed("lang", "label")
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter("lang = label").orderBy(*order).limit(sample)
    return common.learned(rows.select("text", "lang"), lambda rows: fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), idf))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is identified with at least ``keep``."""
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(text))
            yield batch.filter(pa.array((scores >= keep) & (np.array(names, dtype=object) != UNKNOWN)))

    return docs.mapInArrow(run, docs.schema)
