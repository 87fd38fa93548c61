"""The queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_fold import encode_decode
from .byte_bpe import public_path
from .chat_format import conversation_threads, digests, format_threads
from .common import read
from .exact_topk import exact_top_k
from .line_dedup import deduplicated
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .rp_forest import near_duplicate_vectors
from .token_counts import token_counts
from .token_files import encoded_documents
from .toxicity import toxicity_scores


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), path=public_path("byte_bpe_50k.json"), end_id=2)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = r"\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    planted = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(mark)).toDF(*columns)
    rows = read(spark, sf_dir, "conversations").select(columns).union(planted)
    return digests(format_threads(conversation_threads(rows)))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(read(spark, sf_dir, "documents"), path=public_path("byte_bpe_50k.json"), end_id=0)


def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op9_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), path=public_path("byte_bpe_multi_50k.tiktoken"), digest=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), path=public_path("piece_bpe_32k.model"), limit=4096)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_chat_format": op2_chat_format,
    "op3_exact_topk": op3_exact_topk,
    "op4_token_files": op4_token_files,
    "op5_rp_forest": op5_rp_forest,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash": op8_minhash,
    "op9_bpe_fold": op9_bpe_fold,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {}
