"""One query for each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from ._shared import table
from .centroid_clusters import centroid_clusters
from .fingerprints import fingerprints_and_classes
from .ngram_jaccard import ngram_jaccard
from .oracles import SQL
from .packing import pack
from .quality_rules import quality_rules
from .sentencepiece_codec import encode
from .sharding import shard
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .tokenizer_chunks import word_piece_ids
from .toxicity import held_out, score, train
from .warc_fixity import fixity_report, replica
from .whitening import whitened


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.col("ids")
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.xxhash64(ids).alias("ids_xxhash64"), F.crc32("decoded").alias("decoded_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), "unequal")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(table(spark, sf_dir, "documents"), lambda: word_piece_ids(path))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_classes(table(spark, sf_dir, "documents"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    return fixity_report(pages, replica(pages, n % 101 == 7, n % 1013 == 499, n % 503 == 17))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(table(spark, sf_dir, "embeddings"))
    # A long holds the deviation up to about 100 million vectors; beyond that the decimal does.
    return rows.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_decimal"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_token_counts, op4_toxicity, op5_quality_rules, op6_ngram_jaccard, op7_substring_dedup, op8_sharding, op9_fingerprints, op10_warc_fixity, op11_byte_bpe, op12_whitening, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express."""
    return dict(SQL)
