"""Longest-processing-time scheduling of documents into shards.

Rows with equal texts form a group that stays together. Groups go to shards by size, the largest
first, each to the shard with the least so far, through a heap. Groups of equal size are alike to
that rule, so the driver needs how many there are of each size, one row for each different size, and
gives each shard its number of them. Within a size, groups are then numbered by their texts' hashes
and dealt out by these numbers. So every group is scheduled, however small.

Numbers, of groups within a size and of rows within a shard, are given in two steps: within hash
parts, then by the sums of the parts before. So no task sees a whole size or shard.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, text_or_empty
from .ngram_jaccard import few


def least_loaded(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """sizes: (size, number of groups). (size, how many of them each shard gets): the largest first, each group to the shard with the least so far, ties by shard."""
    loads, out = [0] * n_shards, []
    for size, n in sorted(sizes, reverse=True):
        counts = [0] * n_shards
        if size and n > n_shards:
            # All groups that lift a shard from below a level that not too many can reach are placed at once.
            low, high = min(loads), max(loads) + size * n
            while high - low > 1:
                level = (low + high) // 2
                if sum(max(0, -((load - level) // size)) for load in loads) <= n:
                    low = level
                else:
                    high = level
            counts = [max(0, -((load - low) // size)) for load in loads]
        heap = [(load + k * size, shard) for shard, (load, k) in enumerate(zip(loads, counts, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(counts) if size else 0):
            load, shard = heap[0]
            counts[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        if not size:
            counts[loads.index(min(loads))] = n
        loads = [load + k * size for load, k in zip(loads, counts, strict=True)]
        out.append((size, counts))
    return out


def numbered(rows: DataFrame, by: str, order: list[str], parts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, Column]:
    """(rows with part and within, (by, part, before), the number from 0 of a row within its value of `by`, where both are joined)."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = rows.groupBy(by, "part").count()
    before = scratch.cut(sums.select(by, "part", (F.sum("count").over(Window.partitionBy(by).orderBy("part")) - F.col("count")).alias("before")))
    within = F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)) - 1
    return rows.withColumn("within", within), before, F.col("before") + F.col("within")


def shard(docs: DataFrame, n_shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs, under the law `bytes`.

    size: UTF-8 bytes of the text plus overhead. slot: place in the shard, gapless from 0.

    Edge cases: a null text counts as empty, in one group with empty texts; repeated rows get a slot
    each; a group larger than an even share stays whole, alone in its shard as far as the others
    allow; an empty table gives an empty result; further columns are left out.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    scratch, parts = Scratch(spark), max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    raw = scratch.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5")))
    groups = scratch.cut(raw.groupBy("text_md5").agg(F.sum("size").alias("bytes")))
    sizes = [(r.bytes, r["count"]) for r in groups.groupBy("bytes").count().collect()]  # one for each different size
    # Of each size, a shard has the numbers from the end of the shard before on.
    table = []
    for size, counts in least_loaded(sizes, n_shards):
        ends = [sum(counts[: i + 1]) for i in range(n_shards)]
        table.append((size, ends))
    ends = scratch.cut(spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in table], pa.int64()), "ends": pa.array([e for _, e in table], pa.list_(pa.int64()))})))
    own, before, number = numbered(groups, "bytes", ["text_md5"], parts, scratch)
    own = own.join(few(before, before.count()), ["bytes", "part"]).join(few(ends, len(table)), "bytes")
    placed = scratch.cut(own.select("text_md5", F.size(F.filter("ends", lambda e: e <= number)).alias("shard")))
    rows = scratch.cut(raw.join(few(placed, placed.count()), "text_md5").select("doc_id", "size", "text_crc32", "shard"))
    own, before, number = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], parts, scratch)
    scratch.drop(raw, groups, placed)
    return own.join(few(before, before.count()), ["shard", "part"]).select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", number.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
