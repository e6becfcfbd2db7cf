"""The registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.centroid_clustering import cluster_vectors
from millrace.llm.embedding_dedup import embedding_components
from millrace.llm.hamming_search import sign_codes, top_k
from millrace.llm.hamming_sql import OP10
from millrace.llm.inner_product_search import nearest_by_product
from millrace.llm.license_scan import license_scan
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.mixing import mix
from millrace.llm.mixing_sql import OP1
from millrace.llm.packing import pack
from millrace.llm.simhash_docs import simhash_components
from millrace.llm.token_counts import token_counts
from millrace.llm.token_files import token_files
from millrace.llm.toxicity import toxicity
from millrace.llm.vector_codes import vector_codes
from millrace.llm.vector_sql import OP11, OP13

#: Vocabulary files; paths are parameters of the operators.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_read(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 6))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_read(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_read(spark, sf_dir, "documents"), exact_at_any_length=True, runs=None).select("doc_id", "text", "n_lines", "n_dropped")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(_read(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("id % 20 = 0"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_read(spark, sf_dir, "embeddings"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return nearest_by_product(vectors, vectors.where("vec_id % 20 = 0"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_hamming_top_k": op10_hamming_top_k,
    "op11_vector_codes": op11_vector_codes,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES: dict[str, str] = {"op1_mixing": OP1, "op10_hamming_top_k": OP10, "op11_vector_codes": OP11, "op13_centroid_clustering": OP13}
