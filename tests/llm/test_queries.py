import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkloom.llm import bpe, common, ngram_join, quality
from sparkloom.llm import queries as Q

from ..conftest import DATA
from .test_join import brute

SF = f"{DATA}/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want)


def test_join_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs], 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op1_signature_tree_join(spark, SF).collect()}
    assert got == want


def test_pipeline(spark):
    """Each stage drops what it should and keeps the columns; the last one is compared with brute force."""
    docs = common.table(spark, SF, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(common.materialize(stage(spark, steps[-1], SF), name.replace(" ", "-")))
        assert steps[-1].columns == docs.columns and 0 < steps[-1].count() <= steps[-2].count()
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    groups = brute(before.items(), 5, 80)
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(d for d, (_, c) in groups.items() if c == d)
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(final) == {r["doc_id"] for r in steps[4].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    assert sum(d in kept for d, y in labels.items() if y) > 0.95 * sum(labels.values())


def test_one_row_of_each_group_stays(spark):
    """Also where the kept doc_id repeats; rows without a doc_id stay."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (2, text, "c"), (3, "other words here", "d"), (None, text, "e"), (None, text, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, text, "a"), (3, "other words here", "d"), (None, text, "e"), (None, text, "e")], key=str)


def test_stages_take_the_columns_they_get(spark):
    docs = common.table(spark, SF, "documents").limit(30).withColumn("score", common.F.lit(1))
    assert corpus_pipeline.near_duplicates(spark, docs, SF).columns == docs.columns
    assert ngram_join.join(docs).count() == 30 and bpe.digests(docs, Q._tokenizer("byte_bpe_multi_50k.tiktoken")).count() == 30


def test_pipeline_rejects_by_the_classifiers_law(spark):
    folder = f"{DATA}/sf0.01"
    docs = common.table(spark, folder, "documents")
    net = quality.train(docs, common.table(spark, folder, "labels"), common.F.lit(True))
    want = {r["doc_id"] for r in quality.score(docs, net).filter(common.F.col("score") >= quality.KEEP).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_filter(spark, docs, folder).collect()} == want
