import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, search

from .helpers import SCHEMA, documents, empty


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, 1 / 3]) for _ in range(6)], "x") for k in range(300)]
    rows += [(400 + k, rows[0][1], "x") for k in range(40)]  # ties
    rows += [(500, None, "x"), (501, [], "x"), (502, [1.0, None], "x"), (503, [float("nan")], "x"), (504, [float("inf")], "x"), (None, [1.0] * 6, "x"), (505, [2.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = search.quantised(df, "vec_id", "embedding", 256.0)
    real = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and i not in (500, 502, 503, 504)}
    want = []
    for q in sorted(i for i in real if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(real[q], v, strict=False)), i) for i, v in real.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    for blocks in ({}, {"candidate_block": 17, "query_block": 2}):
        got = search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, **blocks)
        assert sorted(map(tuple, got.collect())) == want
    few = vectors.filter("vec_id < 3")
    assert search.top_k(few, few, 5).count() == 6
    assert search.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_top_k_of_repeated_ids(spark):
    """Every row of a repeated query id is answered, whatever the order of rows, and every repeated candidate counts."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, []), (3, [1.0, 5.0])]
    want = []
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(math.floor(a * 4) * math.floor(b * 4) for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:3]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    for these in (rows, rows[::-1]):
        vectors = search.quantised(spark.createDataFrame(these, "vec_id long, embedding array<double>"), "vec_id", "embedding", 4.0)
        assert sorted(map(tuple, search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 3).collect())) == sorted(want)


def test_scores_beyond_64_bits():
    big = np.array([[2**53, 2**53], [-(2**53), 2**53], [1, 0]], dtype=np.int64)
    got = search.Postings(big).scores(big)
    assert got.tolist() == [[2**63 - 2, 0, 2**53], [0, 2**63 - 2, -(2**53)], [2**53, -(2**53), 1]]


def test_tiles_of_a_repetitive_text():
    """One word 100,000 times over: no pair of places is looked at for long."""
    begun = time.process_time()
    assert decontaminate.tiles(np.ones(40, np.uint64), np.ones(100_000, np.uint64)) == [(0, 0, 40)]
    two = decontaminate.tiles(np.tile(np.array([1, 2], np.uint64), 30), np.append(np.tile(np.array([1, 2, 2], np.uint64), 20_000), np.tile(np.array([1, 2], np.uint64), 12)))
    assert time.process_time() - begun < 60 and two[0][2] == 25  # with the 2 before the last part


def test_benchmark_of_several_parts(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(30))) for k in range(20)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items[::2]] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_WORDS", 200)
    assert sorted(map(str, decontaminate.find(docs, bench).collect())) == whole and len(whole) == 10
    assert [r["doc_id"] for r in decontaminate.remove(docs, bench).collect()] == [99]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "plain", "", None, "line\nbreak %0A", "long " * 200, "é😀"]


@pytest.mark.parametrize("budget", [32, 200, 1024])
def test_chat(spark, budget):
    rng = random.Random(budget)
    rows = []
    for conv in [None, -1, *range(12)]:
        n = rng.choice([1, 2, 5, 40])
        for turn in range(n):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool\nx%", None])
            rows.append((conv, turn if turn % 9 else None if turn else 0, role, rng.choice(CONTROL), "x"))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(df, budget)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    shown = made.collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns.sort()
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), digest(loss))
        own = [w for w in shown if w["conv_id"] == conv]
        assert got[conv]["formatted_chars"] == sum(len(w["formatted"]) for w in own)
        first = turns[0][2] == "system"
        for w in sorted(own, key=lambda w: w["window"])[1:]:
            assert w["formatted"].startswith("<|im_start|>system\n") or not first
    # windows stay in the budget unless a turn alone is longer than a quarter
    for w in shown:
        pieces = w["formatted"].split("<|im_end|>\n")[:-1]
        sizes = [len(p.split()) for p in pieces]
        assert max(sizes) > budget // 4 or sum(sizes) <= budget


def test_chat_history_is_repeated_and_masked(spark):
    rows = [("system", "be kind")] + [(("user", "assistant")[k % 2], f"turn {k} " * 4) for k in range(30)]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    made = sorted(chat.windows(df, 160).collect(), key=lambda w: w["window"])
    assert len(made) > 2 and all(w["n_repeated"] >= 2 for w in made[1:])
    for before, w in zip(made[:-1], made[1:], strict=True):
        pieces = w["formatted"].split("<|im_end|>\n")
        assert pieces[0].endswith("be kind") and pieces[w["n_repeated"] - 1] + "<|im_end|>\n" in before["formatted"]
        repeated = sum(len(p) + len("<|im_end|>\n") for p in pieces[: w["n_repeated"]])
        assert all(s["start"] > repeated for s in w["loss_spans"])


def test_chat_escapes(spark):
    texts = [t for t in CONTROL if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]
    assert chat.read_back(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def greedy(a, b, least):
    """Greedy string tiling by definition."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and fa[p + n] and fb[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return covered
        covered += n
        for k in range(n):
            fa[p + k] = fb[q + k] = False


def test_tiles():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randint(1, 12) for _ in range(rng.randint(1, 50))]
        parts = [a[i : i + rng.randint(3, 12)] for i in range(0, len(a), 9)]
        rng.shuffle(parts)
        b = sum(parts, []) + [rng.randint(1, 12) for _ in range(rng.randint(0, 20))]
        found = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 5)
        used_a, used_b = set(), set()
        for p, q, n in found:
            assert a[p : p + n] == b[q : q + n] and n >= 5
            assert not used_a & set(range(p, p + n)) and not used_b & set(range(q, q + n))
            used_a |= set(range(p, p + n))
            used_b |= set(range(q, q + n))
        assert len(used_a) == greedy(a, b, 5)


def test_decontaminate(spark, monkeypatch):
    words = [f"word{k}" for k in range(60)]
    item = " ".join(words[:40])
    moved = " ".join(words[20:40] + ["gap"] + words[:20])
    rows = [(1, item.upper() + "!"), (2, "before " + moved + " after"), (3, " ".join(words[:12])), (4, None), (5, ""), (6, " ".join(f"other{k}" for k in range(3000))), (7, "x " * 5000 + item), (7, "x " * 5000 + item), (None, item)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 0.1, 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(10, item, 1), (11, "too short", 1), (12, None, 1), (13, item, 1), (14, " ".join(words[45:60]), 1)], "item_id long, text string, doc_id int")
    want = sorted((str(d), i) for d in (1, 2, 7, 7, None) for i in (10, 13))
    for size in (decontaminate.PART_WORDS, 40):  # the benchmark in one part, and in several
        monkeypatch.setattr(decontaminate, "PART_WORDS", size)
        found = decontaminate.find(docs, bench).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == want
        assert all(r["coverage"] == 1 and r["n_tiles"] == (2 if r["doc_id"] == 2 else 1) for r in found)
        kept = decontaminate.remove(docs, bench)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.find(empty(spark), bench).collect() == [] and decontaminate.find(documents(spark), bench.limit(0)).collect() == []
