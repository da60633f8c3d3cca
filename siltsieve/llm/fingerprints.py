"""MinHash fingerprints of documents, and the classes of near copies that their bands find.

A text's shingles are its runs of five words. Each of many universal hash functions
(a * x + b mod 2**64) >> 32 keeps its smallest value over them, all in numpy; the low 16 bits of
each minimum make the fingerprint. The share of equal minima estimates the Jaccard similarity.

Near copies: a fingerprint is cut into bands; documents with equal bands are candidates, set first
against a few leaders a band, and where that left several components in a band, by blocks of rows
(see ngram_jaccard). Candidates are verified by exact Jaccard on their whole shingle sets.

To set each document against the next one, rows are dealt into ranges of ids and sorted there; the
first row of every range is also sent, as a last one, to the range before it. So no task needs more
than a range, read once and shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, release, text_or_empty, texts
from .ngram_jaccard import BLOCK_ROWS, SEEN, Rows, Sets, block_key, by_lead, few, keyed, linked_components, named, rows_of, sets_of, shared_lists
from .wordhash import Words, mix, shingles

SLICE_BYTES = 1 << 20
WORDS = 5
N_HASHES = 128
#: Hashes to a band: 64 bits. A pair of similarity 0.8 shares 13 of 32 bands on average, and fewer than LEAST_BANDS once in a million.
BAND, LEAST_BANDS = 4, 2
#: A leader leads in one of so many long bands: near copies share most of 32, so that a few of them tell.
TURNS = 4
RANGES_A_PARTITION = 3

_random = np.random.Generator(np.random.PCG64(7_061_993))
A = _random.integers(0, 1 << 63, 512, np.uint64) * np.uint64(2) + np.uint64(1)
B = _random.integers(0, 1 << 63, 512, np.uint64)


def minhash(values: np.ndarray, counts: np.ndarray, n_hashes: int = N_HASHES) -> np.ndarray:
    """(texts, n_hashes) minima as uint16; a text without shingles has 65535 throughout."""
    out = np.full((len(counts), n_hashes), 0xFFFF, np.uint16)
    some = np.flatnonzero(counts)
    if len(some):
        begins = (np.cumsum(counts) - counts)[some]
        for j in range(n_hashes):
            h = ((values * A[j] + B[j]) >> np.uint64(32)).astype(np.uint32)
            out[some, j] = np.minimum.reduceat(h, begins)  # the low bits
    return out


def minhash_texts(own: list[bytes], n_hashes: int = N_HASHES, k: int = WORDS) -> np.ndarray:
    w = Words(own, lower=True)
    return minhash(*shingles(w.hashes, w.counts, k), n_hashes)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points of text, text with its last half replaced by the beginning of the following one)."""
    s = text.decode(errors="replace")
    half = len(s) // 2
    return len(s), (s[: len(s) - half] + following[: 4 * half].decode(errors="ignore")[:half]).encode()


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, last, doc_id, text), whole buckets to a partition, in descending order; the row after each bucket's last stands at its end, marked last."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # a null id comes last
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", key)
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    k = n * RANGES_A_PARTITION
    cuts = sorted({float(x) for x in ids.withColumn("at", F.col("key").cast("double")).approxQuantile("at", [i / k for i in range(1, k)], 0.1 / k)})
    # Fixed ranges, so that a task that is run again finds the same rows.
    at = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket") if cuts else None

    def bucketed(df: DataFrame) -> DataFrame:
        df = df.withColumn("at", F.col("key").cast("double"))
        return (at.transform(df) if at else df.withColumn("bucket", F.lit(0.0))).withColumn("bucket", F.col("bucket").cast("int")).drop("at")

    heads = sorted((r.bucket, r.key) for r in bucketed(ids).groupBy("bucket").agg(F.max("key").alias("key")).collect())  # one for each range
    above = [heads[(i + 1) % len(heads)][0] for i in range(len(heads))]
    table = spark.createDataFrame(pa.table({"bucket": pa.array([b for b, _ in heads], pa.int32()), "head": pa.array([h for _, h in heads], pa.int64()), "above": pa.array(above, pa.int32())}))
    to = F.array(F.struct("bucket", F.lit(0).alias("last")))
    both = F.when(F.col("key") == F.col("head"), F.concat(to, F.array(F.struct(F.col("above").alias("bucket"), F.lit(1).alias("last"))))).otherwise(to)
    rows = bucketed(rows).join(F.broadcast(table), "bucket").withColumn("to", F.explode(both)).select("to.*", "doc_id", "key", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("last"), F.col("key").desc(), F.xxhash64("text")).select("bucket", "last", "doc_id", "text")


def fingerprints(docs: DataFrame, n_hashes: int = N_HASHES, id_col: str = "doc_id", text_col: str = "text", node_col: str | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    The edited text has its last half replaced by the beginning of the next document in descending
    order of ids (after the last: the first). near_*: the share of equal minima, 0 to 1.
    node_col: also give the name of the text's shingle set (null without words) by this name.

    Edge cases: a null text counts as empty; texts without words have equal fingerprints; of rows
    with equal ids the order is that of their texts' hashes; a null id comes last; a single row is
    its own next; an empty table gives an empty result; further columns are left out.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), texts(batch), strict=True):
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES and len(held) > 1:
                    yield held
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield held

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            prints = minhash_texts([r[3] for r in rows], n_hashes)
            own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not own:
                continue
            new = [edited(rows[i][3], rows[i + 1][3]) for i in own]
            prints_new = minhash_texts([t for _, t in new], n_hashes)
            old = prints[own]
            sets = Sets([rows[i][3] for i in own], WORDS) if node_col else None
            more = [pa.array(sets.names, mask=sets.counts == 0)] if node_col else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in own], pa.int64()),
                    pa.array([n for n, _ in new], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for _, t in new]),
                    pa.array([x.astype(">u2").tobytes().hex() for x in old]),
                    pa.array([x.astype(">u2").tobytes().hex() for x in prints_new]),
                    pa.array((old == prints_new).mean(axis=1)),
                    pa.array((old == prints[[i + 1 for i in own]]).mean(axis=1)),
                    *more,
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *["node"] * len(more)],
            )

    out = in_ranges(docs, id_col, text_col).mapInArrow(compute, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + (", node long" if node_col else ""))
    return out.withColumnsRenamed({"doc_id": id_col, "node": node_col} if node_col else {"doc_id": id_col})


def band_lists(docs: DataFrame, k: int, n_hashes: int, scratch: Scratch) -> DataFrame:
    """(h, node, size, place, col, blocks) of every band of each distinct shingle set, as ngram_jaccard's postings; a band of too many sets for one task is dealt into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, s in sets_of(batches, k):
            new = []
            for i, (n, name) in enumerate(zip(s.counts.tolist(), s.names.tolist(), strict=True)):
                if n and name not in seen:
                    seen.add(name)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if not new:
                continue
            bands = np.ascontiguousarray(minhash(s.values, s.counts, n_hashes)[new]).view(np.uint64)
            n = bands.shape[1]
            h = mix(bands + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(s.names[new], n)), pa.array(np.repeat(s.counts[new], n).astype(np.int32))], ["h", "node", "size"])

    bands = scratch.cut(docs.mapInArrow(run, "h long, node long, size int"))
    large = scratch.cut(bands.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select("h", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    rows = bands.join(few(large, large.count()), "h", "left")
    split, h = F.col("blocks").isNotNull(), F.col("h")
    return rows.select(F.when(split, block_key("h", F.pmod("node", "blocks"))).otherwise(h).alias("h"), "node", "size", F.lit(0).alias("place"), F.when(split, h).alias("col"), F.coalesce("blocks", F.lit(1)).alias("blocks"))


def near_links(docs: DataFrame, k: int, percent: int, n_hashes: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[Rows, DataFrame]:
    """(rows_of all documents, (node, component) of nodes with links of at least this similarity)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = keyed(docs, id_col, text_col)

    def often(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.sum("led").alias("led")).where(F.col("c") >= LEAST_BANDS).select(*by_lead())

    lists = scratch.cut(shared_lists(band_lists(docs, k, n_hashes, scratch), percent, parts))
    scratch.drop(but=lists)
    release(docs.sparkSession)
    rows = rows_of(docs, k, lists, scratch)
    return rows, linked_components(rows, lists, often, percent, parts, scratch, TURNS)


def near_copies(docs: DataFrame, k: int = WORDS, percent: int = 80, n_hashes: int = N_HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id) of every row of docs: the smallest id that links of at least this similarity reach.

    Edge cases: as ngram_jaccard; a text without words is alone.
    """
    scratch = Scratch(docs.sparkSession)
    rows, found = near_links(docs, k, percent, n_hashes, id_col, text_col, scratch)
    names = scratch.cut(named(rows.docs, found))
    return rows.docs.join(few(names, names.count()), "node", "left").select(F.col("doc_id").alias(id_col), F.coalesce("component_id", "doc_id").alias("class_id"))


def fingerprints_and_classes(docs: DataFrame, percent: int = 80, n_hashes: int = N_HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints of every row of docs, each with near_copies' class_id; rows meet by their shingle sets, so repeated and null ids do no harm."""
    scratch = Scratch(docs.sparkSession)
    rows, found = near_links(docs, WORDS, percent, n_hashes, id_col, text_col, scratch)
    names = scratch.cut(named(rows.docs, found).select(F.col("node").alias("__node"), F.col("component_id").alias("__class")))
    scratch.drop(but=names)
    release(docs.sparkSession)
    out = fingerprints(docs, n_hashes, id_col, text_col, node_col="__node")
    return out.join(few(names, names.count()), "__node", "left").withColumn("class_id", F.coalesce("__class", id_col)).drop("__node", "__class")
