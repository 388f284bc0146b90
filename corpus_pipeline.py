"""The corpus pipeline: documents in, packs of training text out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents:

1. language ID drops the documents whose language can't be told,
2. the quality classifier, fitted on the labels of the documents still there,
   drops those of low quality,
3. line dedup keeps one line of each group of similar lines over the whole
   corpus, and drops documents with no line left,
4. the n-gram Jaccard join keeps one document of each group of near copies,
5. packing fills windows with documents retrieved by BM25: for each 50th doc_id
   from the whole corpus, for the others from their shard.

SQL can't express these models and components, so ORACLE_SQL is None and the
tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbena.llm import langid, line_dedup, ngram_join, packing, quality
from verbena.llm.blobs import cut


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, every=50)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("packing", windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
