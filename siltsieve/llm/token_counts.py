"""Token counts of whole texts.

Texts come in Arrow batches. They are cut at safe boundaries, and the different pieces of a slice of
texts are encoded in batches of about equal bytes, so that neither many short nor a few long texts make
a batch large; only lengths leave the worker.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
repeated rows are counted each; further columns, also any named like the results, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty, text_slices
from .tokenizer_chunks import byte_level_counter

SLICE_BYTES = 16 << 20


def token_counts(docs: DataFrame, tokenizer_path: str, over: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs. tokenizer_path: a byte-level BPE of the tokenizers library."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_level_counter(tokenizer_path)
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(counter.counts(own))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
