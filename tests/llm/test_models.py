import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, langid, maxent, quality
from sparkloom.llm import queries as Q

from ..conftest import DATA
from .helpers import documents, empty, words

SF = f"{DATA}/sf0.01"


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in Q.op8_byte_cnn_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (crc(d, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in got.items())
    held = [(got[d]["score"], y) for d, y in labels.items() if crc(d, 5) == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_network_equals_plain_convolution():
    net = quality.fit([b"abc" * 90, b"|||" * 200, b"", b"hello there"], np.array([1, 0, 0, 1], np.float32), epochs=2)
    for text in (b"", b"a", b"xyz" * 300, bytes(range(256)) * 5):
        padded = np.frombuffer(text + bytes(quality.WIDTH), np.uint8)
        n = max(1, len(text))
        values = np.array([sum(net.filters[k, padded[p + k]] for k in range(quality.WIDTH)) for p in range(n)])
        blocks = [np.maximum(values[a : a + quality.BLOCK].max(axis=0) + net.offset, 0) for a in range(0, n, quality.BLOCK)]
        chunks = [np.maximum(blocks[i], blocks[min(i + 1, len(blocks) - 1)]) for i in range(len(blocks))]
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.weights + net.bias
        got = quality._scores(net, pa.array([text.decode("latin-1").encode("utf-8").decode()]) if False else pa.array([text], pa.binary()))[0]
        assert got == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-5)


def test_quality_awkward(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (31, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(df, labels, F.lit(True))
    assert quality.score(df, net).count() == df.count()
    kept = quality.accepted(df, net, 0.0)
    assert kept.count() == df.count() and kept.columns == df.columns
    blank = quality.train(df, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(df, blank).collect()} == {0.5}
    assert quality.score(empty(spark), net).collect() == []


def test_language_held_out(spark):
    got = Q.op6_ftrl_language(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_language_awkward(spark):
    df = documents(spark)
    model = langid.train(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb")), F.lit(True))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[4]["lang_pred"] in ("aa", "bb")
    assert langid.accepted(df, model, 0.0).columns == df.columns
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(empty(spark), model).collect() == []


def test_document_frequencies(spark):
    df = documents(spark)
    total, counts = langid.document_frequencies(df)
    want = np.zeros(langid.BUCKETS, int)
    for r in df.collect():
        want[np.unique(langid.grams(pa.array([r["text"]], pa.string()))[0])] += 1
    assert total == df.count() and (counts == want).all()


def brute_base(rows, held):
    tokens = [[*words(t), None] for _, t in rows]
    counts: dict = {}
    for (d, _), ws in zip(rows, tokens, strict=True):
        if not held(d):
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in tokens]
    return n, counts, base, tokens


def test_scoring_awkward(spark, monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda d: d is not None and crc(d, 10) == 0
    n, counts, base, tokens = brute_base(rows, held)
    got = maxent.score(df, common.crc_remainder("doc_id", 10) == 0).collect()
    want = sorted((str(d), held(d), len(ws), sum(counts.get(w, 0) > 0 for w in ws), n, round(b, 6)) for (d, _), b, ws in zip(rows, base, tokens, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert maxent.score(empty(spark), F.lit(False)).collect() == []
    nothing = maxent.score(df, F.lit(True)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["base_score"] == 0 for r in nothing)


def test_scores_equal_plain_ones(spark, monkeypatch):
    """Scores by dictionaries and bisection, given the weights and classes of the blocks' first factor."""
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(maxent, "PART_TOKENS", 300)  # several parts
    rng = np.random.default_rng(3)
    weights, class_of = maxent.Weights(), rng.integers(1, maxent.CLASSES, maxent.BUCKETS)
    weights.rows[:], class_of[0] = rng.normal(size=weights.rows.shape), 0
    monkeypatch.setattr(maxent, "train", lambda made, class_of: weights)
    monkeypatch.setattr(maxent, "classes", lambda profiles: class_of)
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    held = lambda d: d is not None and crc(d, 10) == 0
    _, counts, _, tokens = brute_base(rows, held)

    def bucket(w):
        if w is None:
            return 0
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(maxent.K.RangeHasher(raw, lower=True)(np.array([max(0, len(raw) - 4)]), np.array([len(raw)]))[0] % np.uint64(maxent.BUCKETS - 1)) + 1

    bucket_of = {w: bucket(w) for ws in tokens for w in ws}
    kind = {w: int(class_of[b]) for w, b in bucket_of.items()}
    n, v = [0] * maxent.CLASSES, [0] * maxent.CLASSES
    for w, c in counts.items():
        n[kind[w]] += c
        v[kind[w]] += 1
    share = {w: (counts.get(w, 0) + 0.1) / (n[k] + 0.1 * (v[k] + 1)) for w, k in kind.items()}
    pairs: dict = {}
    for (d, _), ws in zip(rows, tokens, strict=True):
        for x, y in zip([None, *ws], ws, strict=False):
            if not held(d):
                pairs[x, y] = pairs.get((x, y), 0) + 1
    context: dict = {}
    for (x, y), c in pairs.items():
        context[x, kind[y]] = context.get((x, kind[y]), 0) + c

    def weight(x, y):
        low, high = -40.0, 40.0
        for _ in range(100):
            w = (low + high) / 2
            if pairs[x, y] - context[x, kind[y]] * share[y] * math.exp(w) - maxent.PENALTY * w > 0:
                low = w
            else:
                high = w
        return low

    learned = {pair: weight(*pair) for pair in pairs}
    norm: dict = {}
    for (x, y), w in learned.items():
        norm[x, kind[y]] = norm.get((x, kind[y]), 1.0) + share[y] * (math.exp(w) - 1)
    want = []
    for (d, _), ws in zip(rows, tokens, strict=True):
        total, before = 0.0, [None, None, None]
        for w in ws:
            b = [bucket_of[x] for x in before]
            features = [0, 1 + b[0], 1 + maxent.BUCKETS + b[1], 1 + 2 * maxent.BUCKETS + b[2], 1 + 3 * maxent.BUCKETS + (b[0] * 40503 + b[1] * 60013 >> 3) % maxent.PAIRS]
            logits = weights.rows[features].astype(float).sum(axis=0)
            total += logits[kind[w]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
            total += math.log(share[w]) + learned.get((before[0], w), 0.0) - math.log(norm.get((before[0], kind[w]), 1.0))
            before = [w, *before[:2]]
        want.append((str(d), len(ws), total / math.log(10)))
    got = [(str(r["doc_id"]), r["n_tokens"], r["score"]) for r in maxent.score(df, common.crc_remainder("doc_id", 10) == 0).collect()]
    assert [x[:2] for x in sorted(got)] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], rel=1e-4)


def test_pair_weights_are_roots():
    rng = np.random.default_rng(5)
    context = rng.integers(1, 10**9, 2000)
    count = np.minimum(rng.integers(0, 1000, 2000), context)
    share = 10 ** -rng.uniform(0, 9, 2000)
    w = maxent.pair_weights(count, context, share)
    assert (w[count == 0] == 0).all()
    seen = count > 0
    gradient = count - context * share * np.exp(w) - maxent.PENALTY * w
    assert (np.abs(gradient[seen]) < 1e-5 * (count + context * share)[seen]).all()


def test_scoring_beats_its_base(spark):
    """By well over the gain of the classes alone (8 %), as it knows whole words before others."""
    got = Q.op3_hashed_maxent(spark, SF).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.88 * sum(r["base_score"] for r in got)


def test_model_is_a_distribution():
    """Probabilities of all classes sum to one after any updates, and so do those of the tokens of a class."""
    rng = np.random.default_rng(0)
    weights = maxent.Weights()
    rows = rng.integers(0, maxent.ROWS, (500, 4)).astype(np.int32)
    target, met = rng.integers(0, maxent.CLASSES, 500), np.zeros(maxent.ROWS)
    for _ in range(5):
        weights.update(rows, target, met)
    x = weights.logits(rows)
    p = np.exp(x - x.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert p[np.arange(500), target].mean() > 2 / maxent.CLASSES
    c = np.array([3, 1, 6])
    assert ((c + 0.1) / (c.sum() + 0.1 * (len(c) + 1))).sum() + 0.1 / (c.sum() + 0.1 * (len(c) + 1)) == pytest.approx(1)


def test_runs_of_any_length_are_summed():
    """What a step sums by feature, in 32 bits, from rows of 16 bits (which sort by radix)."""
    rng = np.random.default_rng(8)
    block = maxent.Block([1, 2], np.zeros(2, bool), np.array([0, 3, 9]), np.arange(9, dtype=np.int32) % 4, np.array([0, 7, 4095, 20], np.uint16), None, None)
    rows = block.features()[1]
    assert rows.dtype == np.uint16 and rows.max() < maxent.ROWS
    lengths = np.array([1, 2, 3, maxent.SHORT_RUN - 1, maxent.SHORT_RUN, maxent.SHORT_RUN + 1, 1, 300, 1, 2])
    names = np.repeat(rng.permutation(len(lengths)), lengths)[rng.permutation(lengths.sum())].astype(np.uint16)
    values = rng.normal(size=(len(names), 5)).astype(np.float32)
    order = np.argsort(names, kind="stable")
    used, starts, counts = np.unique(names[order], return_index=True, return_counts=True)
    got = maxent._run_sums(values, order, starts, counts)
    want = np.array([values[names == k].sum(axis=0, dtype=np.float64) for k in used])
    assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-4)


def test_classes():
    rng = random.Random(1)
    profiles = np.zeros((200, 8))
    for k in range(1, 200):
        profiles[k, (k % 2) * 4 : (k % 2) * 4 + 4] = [rng.randint(50, 99) for _ in range(4)]
    got = maxent.classes(profiles, 3)
    assert got[0] == 0 and set(got[2::2]) != set(got[1::2]) and len(set(got[2::2])) == len(set(got[1::2])) == 1


@pytest.mark.parametrize("partitions", [4, 64])
def test_sums_of_tasks(spark, partitions):
    def run(batches):
        total = np.zeros(1000)
        for batch in batches:
            total[:] += batch.column(0).to_numpy().sum() + np.arange(1000)
        yield from maxent._pieces(total)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = spark.range(0, 70, 1, 7).mapInArrow(run, "part int, salt int, data binary")
        assert np.allclose(maxent._summed(rows, 1000), sum(range(70)) + 7 * np.arange(1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_executors_learn(spark, monkeypatch):
    """The driver holds neither the texts to learn from nor what learning takes of memory."""
    df = spark.createDataFrame([(k, f"text {k}", "aa") for k in range(20)], "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "fit", lambda texts, labels: (os.getpid(), len(texts), float(labels.sum())))
    monkeypatch.setattr(langid, "fit", lambda texts, labels, idf: (os.getpid(), len(texts), len(labels)))
    learners = quality.train(df, labels, F.lit(True)), langid.train(df, F.lit(True))
    assert [x[1:] for x in learners] == [(20, 10.0), (20, 20)] and os.getpid() not in [x[0] for x in learners]
