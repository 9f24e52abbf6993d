"""The corpus pipeline: filter, deduplicate, decontaminate and tokenize the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents, and further ones that docs may have, whatever their names.

Null texts count as empty ones: they go by their quality score, or have no language.
Very long texts are taken whole. Rows with a null doc_id go through all stages. Rows
that repeat are judged alike; of a kept doc_id that repeats, the near-duplicate stage
keeps one row. Empty tables give empty tables (without labels or languages to learn
from, nothing is known to be good, and nothing stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, decontaminate, langid, ngram_join, quality

#: The near-duplicate stage takes five words and a similarity of 0.8.
NGRAM, THRESHOLD = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents are rejected below this score, the classifier's own.
QUALITY = quality.KEEP


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the byte-level network scores at least QUALITY."""
    common.text_batches(spark)
    net = quality.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return quality.accepted(docs, net, QUALITY)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified."""
    common.text_batches(spark)
    return langid.accepted(docs, langid.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates.

    Rows with a null doc_id belong to no group and stay. Of rows that repeat a kept
    doc_id the least one stays, by the text and then the other columns.
    """
    common.text_batches(spark)
    classes = common.materialize(ngram_join.join(docs, NGRAM, THRESHOLD).select("doc_id", "component_id"), "classes")
    dropped = common.materialize(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    repeated = common.materialize(classes.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    kept = common.join_small(docs, dropped, "doc_id", "left_anti").select(*docs.columns)
    if common.is_empty(repeated):
        return kept
    order = ["text", *(c for c in docs.columns if c != "text")]
    one = common.join_small(kept, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("least")).select("least.*").select(*docs.columns)
    return common.join_small(kept, repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    import public_tokenizers

    common.text_batches(spark)
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_filter),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: The trained stages have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
