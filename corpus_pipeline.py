"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, BPE encoding.

Every stage works on all that the one before it kept and returns the columns of ``documents``; the last returns a
row of token digests per document taken. Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deucebase.llm.bpe import token_report
from deucebase.llm.common import save
from deucebase.llm.exact_dedup import drop_copies
from deucebase.llm.language_id import keep_known
from deucebase.llm.mixing import apply_mix
from deucebase.llm.ngram_join import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go; ``lang`` is the predicted one.

    Null, empty and letterless texts go; a tie goes to the first language in order; repeated rows are judged alike. If
    no row has a label, all go. An empty table stays empty; further columns are kept.
    """
    return keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    Null counts as the empty text. Of rows equal in text and id one stays; a null id gives way to any other. An empty
    table stays empty; further columns are kept.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by Jaccard similarity 0.8 or more on five-word shingles, the smallest doc_id stays.

    Rows without words or with a null id are in no group and stay. Where texts of a group share its smallest id, that of
    the smallest text hash stays. An empty table stays empty; further columns are kept.
    """
    return keep_one(docs, n=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice.

    A null source is a source, last in order; null and empty texts have size 0 and are drawn at their source's rate.
    Repeated rows are drawn one by one. An empty table stays empty; further columns are kept.
    """
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document of the mix.

    Null counts as the empty text: no token. A row for every row, repeated ones too; an empty table gives none.
    """
    return token_report(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("bpe", tokens)]

#: SQL cannot express language ID, the balanced draw or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
