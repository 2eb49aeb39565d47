"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .alignment import align_documents
from .chat import format_conversations
from .clustering import cluster_vectors
from .common import checkpoint, delete_folder, shared_folder, table
from .decontaminate import contamination_report
from .html_text import extract_text, fit, labelled_sample
from .line_dedup import line_report
from .minhash import near_duplicates
from .pieces import encode_documents
from .quality import quality_report
from .secrets import Formats, credential_sample, scan_secrets
from .sharding import assign_shards
from .token_files import CHUNKS, read_documents, write_token_files
from .url_filter import filter_urls

#: Vocabularies of public tokenizers where they are installed; never copied.
PIECES, BYTE_PAIRS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: The URL rules of the contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_words")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, and the ids decoded again."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), PIECES, with_decoded=True)
    return encoded.select("doc_id", "n_pieces", "ids", "ids_crc32", "round_trip", F.crc32("decoded").alias("decoded_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the stated query set: the URLs of every hundredth page, against all pages."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, pages.filter(F.col("page_id") % 100 == 0).select("url"), URL_RULES)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sample = [(r["kind"], r["credential"]) for r in credential_sample(documents).collect()]  # at most SAMPLE a kind
    return scan_secrets(documents, Formats(sample))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), BYTE_PAIRS, path)
    got = checkpoint(read_documents(spark.read.schema(CHUNKS).parquet(path)))
    delete_folder(spark, path)
    return got


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), BYTE_PAIRS, PIECES)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(labelled_sample(pages)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_quality_rules, op2_sentencepiece, op3_sharding, op4_benchmark_decontamination, op5_url_filters,
    op6_chat_formatting, op7_line_dedup, op8_secret_scans, op9_token_files, op10_minhash_near_dedup,
    op11_centroid_clustering, op12_token_alignment, op13_html_extraction, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
