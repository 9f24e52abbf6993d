import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components, ngram_join

from .helpers import documents, empty, words


def brute(rows, ngram, threshold):
    sets = {}
    for d, text in rows:
        w = words(text)
        if d is not None:
            sets[d] = frozenset(tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)) if len(w) >= ngram else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(df, ngram, threshold, **more):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = ngram_join.join(df, ngram, threshold, **more).collect()
    assert len(got) == len(rows)
    want = brute(rows, ngram, threshold)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    return want


def family(spark, seed, count):
    """Chains of edits, so that links are some and components long."""
    rng = random.Random(seed)
    rows, base = [], [f"w{rng.randint(0, 400)}" for _ in range(90)]
    for k in range(count):
        if k % 25 == 0:
            base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 12, 40, 90, 200]))]
        base = list(base)
        base[rng.randrange(len(base))] = f"x{k}"
        rows.append((k * 3, " ".join(base)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("ngram, threshold", [(4, 85), (5, 80), (2, 60)])
def test_awkward_rows(spark, ngram, threshold):
    want = check(documents(spark), ngram, threshold)
    assert any(c != d for d, (_, c) in want.items())


def test_families_and_chunks(spark):
    df = family(spark, 5, 150)
    want = check(df, 4, 85)
    assert len(set(c for _, c in want.values())) < 140
    check(df, 4, 85, chunk=7)  # groups cut into many cells


def brute_links(rows, ngram, threshold):
    sets = {}
    for d, text in rows:
        w = words(text)
        if d is not None:
            sets[d] = frozenset(tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)) if len(w) >= ngram else frozenset([tuple(w)] if w else [])
    out = {}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                out[a, b] = (both, both / (len(sets[a]) + len(sets[b]) - both))
    return sets, out


def test_repeated_ids_with_other_texts(spark):
    """No link is lost, whatever the order of rows: all rows of a doc_id belong together."""
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(50)]
    rows = [(5, one), (5, two), (7, [*one[:-1], "x"]), (8, [*two[:-1], "y"]), (9, ["z"] * 30), (5, one)]
    rows = [(d, " ".join(w)) for d, w in rows]
    for these, count in ((rows, True), (rows[::-1], True), (rows[3:] + rows[:3], False)):
        df = spark.createDataFrame(these, "doc_id long, text string").repartition(3)
        got = [r.asDict() for r in ngram_join.join(df, 4, 85, count=count).collect()]
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (8, 5), (9, 9)}
        assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == [(5, 47), (5, 57), (5, 57), (7, 57), (8, 47), (9, 1)]
        assert not count or {(r["doc_id"], r["n_links"]) for r in got} == {(5, 1), (7, 1), (8, 1), (9, 0)}


def test_rounds_join_chunks_and_outliers(spark, monkeypatch):
    """A group of many chunks: near copies of one text, members linked through one other only, and strangers that share its rarest words."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(60):
        text = list(base)
        text[rng.randrange(80)] = f"e{k}"
        rows.append(text)
    for k in range(12):  # a chain away from the base
        base = [*base[1:], f"c{k}"]
        rows.append(base)
    rows += [[*[f"b{k}" for k in range(20)], *[f"s{n}-{k}" for k in range(30)]] for n in range(15)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    check(df, 4, 85, chunk=4)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    check(df, 4, 85, chunk=11, count=True)


def test_long_texts_with_a_short_one_are_no_candidates(spark):
    """Long texts of one cell that share next to nothing are told apart, whatever short text the cell has besides; near ones are found."""
    rng = np.random.default_rng(4)
    texts = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 40, *[600] * 20, 2000)]
    near = np.unique(np.append(texts[5][8:], rng.integers(0, 1 << 63, 8, dtype=np.uint64)))
    wide = np.unique(np.append(texts[1], rng.integers(0, 1 << 63, 6, dtype=np.uint64)))
    edge = [np.unique(rng.integers(0, 1 << 63, 510, dtype=np.uint64))]
    edge.append(np.unique(np.append(edge[0], rng.integers(0, 1 << 63, 20, dtype=np.uint64))))  # one bitmap is twice as wide
    texts += [near, wide, *edge]
    rows = [(1, k, k, k, len(x), bytearray(ngram_join.bitmap(x).tobytes())) for k, x in enumerate(texts)]
    cells = spark.createDataFrame(rows, "cell long, node long, side long, label long, n long, map binary")
    got = {(r["a"], r["b"]) for r in ngram_join._candidates(cells, 85).collect()}
    assert got == {(23, 5), (24, 1), (26, 25)}


def test_texts_outside_clusters_are_not_shuffled(spark, monkeypatch):
    """Of many chosen sets the texts are found by a bitmap, which leaves out most others before the join, and none that is wanted."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 20)
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    chosen = texts.filter("doc_id % 50 = 7").select("doc_id", F.col("doc_id").alias("node"))
    chosen.measured = {"rows": chosen.count()}
    ids = {r["doc_id"] for r in ngram_join._marked(texts, chosen, 1 << 16).collect()}
    assert {*range(7, 3000, 50)} <= ids and len(ids) < 100
    wanted = ngram_join._wanted(texts, chosen)
    assert sorted((r["node"], r["text"]) for r in wanted.collect()) == [(k, f"text {k}") for k in range(7, 3000, 50)]
    assert "MapInArrow" in wanted._jdf.queryExecution().executedPlan().toString()


def test_prefixes_share_a_key():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 1 << ngram_join.SKETCH_BITS).astype(np.uint64)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.append(rng.permutation(a)[int(rng.integers(0, 8)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        first = np.array([0, len(a), len(a) + len(b)])
        row, at = ngram_join.rare_first(np.append(a, b), first, counts, 85)
        keys = np.append(a, b)[at]
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(keys[row == 0], keys[row == 1]).size


@pytest.mark.parametrize("chunk", [7])
def test_every_link_is_counted(spark, chunk):
    """Near copies, exact copies of them, and chains: all pairs, not only a forest."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = [(1000 + k, " ".join(base[:-1] + [f"y{k // 2}"])) for k in range(40)]
    rng.shuffle(rows)
    near = spark.createDataFrame(rows, "doc_id long, text string")
    df = documents(spark).select("doc_id", "text").unionByName(family(spark, 6, 60).withColumn("doc_id", F.col("doc_id") + 2000)).unionByName(near)
    sets, want = brute_links([(r["doc_id"], r["text"]) for r in df.collect()], 4, 85)
    degree = collections.Counter(x for pair in want for x in pair)
    got = ngram_join.join(df, 4, 85, chunk, count=True).collect()
    assert len(got) == df.count() and max(degree.values()) >= 39
    assert all(r["n_links"] == (None if r["doc_id"] is None else degree[r["doc_id"]]) for r in got)
    plain = ngram_join.join(df, 4, 85, chunk).collect()
    assert sorted(map(str, plain)) == sorted(str(r).rsplit(", n_links", 1)[0] + ")" for r in got)
    found = {(r["doc_a"], r["doc_b"]): (r["shared"], r["similarity"]) for r in ngram_join.pairs(df, 4, 85, chunk).collect()}
    assert found == want


def test_empty(spark):
    assert ngram_join.join(empty(spark)).collect() == []
    assert ngram_join.join(empty(spark), count=True).collect() == []


def test_tree_finds_every_component():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.choice(10_000, 80, replace=False)
        texts = []
        for _ in range(int(rng.integers(2, 120))):
            x = base.copy()
            x[rng.integers(0, 80, int(rng.integers(0, 14)))] = rng.integers(10_000, 1 << 40, 1)
            texts.append(np.unique(x).astype(np.uint64))
        sizes = np.array([len(x) for x in texts])
        found = ngram_join.links(sizes, [ngram_join.bitmap(x) for x in texts], 85, ngram_join.exact_counter(texts, 85))
        label = list(range(len(texts)))
        for a, b in found:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        want = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                both = len(np.intersect1d(texts[a], texts[b]))
                if 100 * both >= 85 * (len(texts[a]) + len(texts[b]) - both):
                    want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
        assert label == want and len(found) == len(texts) - len(set(want))


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[node] == min(seen)
    assert len(got) == len(near)
