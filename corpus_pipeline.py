"""From raw documents to packed batches: toxicity filter, exact and near deduplication, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again by the next. For
all of them null texts count as empty, long texts are read whole, rows that share an id are judged by their own texts
where nothing else is said, an empty table gives an empty table, and columns other than doc_id and text pass through as
they are, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontam, exact_dedup, ngram_join, packing, toxicity
from ledgerline.llm.tables import read, remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier scores below its threshold. It learns from the labelled rows of docs that are not held out;
    without labels of both classes all docs stay. A row without id teaches nothing and is scored like any other."""
    labels = read(spark, sf_dir, "labels").where(toxicity.learnable())
    return toxicity.accepted(docs, toxicity.fit(docs.where(toxicity.learnable()), labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the docs with equal texts: the one with the largest id, of rows that share it too one. A row without id stays only
    where its text has no other row."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of docs that links of Jaccard similarity 0.8 and more connect: the one with the least id. Rows that
    share an id go or stay together; rows without id stay, and texts without words, which are like no other."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item. Rows that share an id go together if one of them holds one; rows without id stay. An
    empty benchmark leaves all docs."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, place of each doc, null and repeated ids included; an empty text has no
    tokens, and one above the budget is a batch alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier and the stages after it have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
