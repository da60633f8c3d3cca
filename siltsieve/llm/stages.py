"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of docs, also those whose names the operators use. What each does:

- null and empty texts: toxicity scores them as texts without terms (they stay), quality rules reject
  them (fewer than 50 words), the Jaccard join keeps them all, substring dedup leaves them alone,
  packing gives them the separator alone;
- repeated rows: the two filters and substring dedup treat each like the other, the Jaccard join keeps
  one of them, packing packs each that is left;
- ties: the Jaccard join keeps the smallest id (a null id first), of equal ids the smallest hash of the
  text; substring dedup keeps a passage in the smallest id;
- very long texts are read whole by all of them;
- an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, table
from .ngram_jaccard import keep_one
from .packing import pack
from .quality_rules import keep_good
from .substring_dedup import substring_dedup
from .tokenizer_chunks import word_piece_ids
from .toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    bounded_batches(spark)
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose host is rejected go."""
    bounded_batches(spark)
    return keep_good(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id; rows are told apart by id and text (see keep_one)."""
    bounded_batches(spark)
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left, and n_chars is that of the text left."""
    bounded_batches(spark)
    out = substring_dedup(docs).where((F.size("removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return out.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack(docs, lambda: word_piece_ids(path))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("n-gram Jaccard join", ngram_join), ("substring dedup", repeats), ("packing", packing)]
