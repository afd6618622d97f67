"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.ngram_join import join_similar

    return join_similar(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.exact_dedup import name_documents

    return name_documents(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.chat_format import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.lm_score import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from deucebase.llm.bpe import token_report

    return token_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_mixing, op2_html_extraction, op3_embedding_dedup, op4_ngram_join, op5_exact_dedup, op6_language_id, op7_chat_format, op8_secrets, op9_pseudo_likelihood, op10_bpe)}
    return found | {"pipeline": lambda spark, sf_dir: import_module("corpus_pipeline").run(spark, sf_dir)}


OP5 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5}
