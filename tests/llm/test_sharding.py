import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import sharding

from .helpers import documents, empty


def least_capacity(sizes, shards):
    for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_minimax(shards):
    rng = random.Random(shards)
    for _ in range(40):
        sizes = [rng.choice([1, 5, 50]) * rng.randint(1, 9) for _ in range(rng.randint(1, 60))]
        capacity, ends = sharding.minimax_cuts(np.array(sizes), shards)
        assert capacity == least_capacity(sizes, shards)
        parts = np.diff([0, *ends])
        assert parts.sum() == sum(sizes) and parts.max() <= capacity


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"], []).append(r)
    least = lambda g: min((r["doc_id"] if r["doc_id"] is not None else -(2**63)) for r in g)
    return sorted(groups.values(), key=least)


def test_assign(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 3)  # so that all levels are searched
    df = documents(spark)
    rows = df.collect()
    size = lambda r: len((r["text"] or "").encode()) + 1
    got = sharding.assign(df, 8).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r["doc_id"]), size(r), zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    shard_of, loads = {}, {}
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in got:
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    for s in loads:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert max(loads.values()) == least_capacity([sum(size(r) for r in g) for g in groups_of(rows)], 8)


def test_one_large_group(spark):
    df = spark.createDataFrame([(k, "same text" if k % 3 == 0 else f"text {k}", "x") for k in range(200)], "doc_id long, text string, shard string")
    got = sharding.assign(df, 8)
    assert got.count() == 200 and got.filter("size = 10").select("shard").distinct().count() == 1


def test_empty_and_files(spark, tmp_path):
    assert sharding.assign(empty(spark)).collect() == []
    df = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    sharding.write(df, sharding.assign(df, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50 and len(list((tmp_path / "out").glob("shard=*"))) == 4
