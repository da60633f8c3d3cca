"""WARC records and a Merkle audit of their replicas.

Records are hashed (SHA-256) one by one where they lie; only hashes, offsets and lengths move. A
tree stands over them: records in the order of their offsets, ranges of offsets, files, groups of
files, root. Every node is the hash of its children in order, so no node has more children than a
range has records, a file ranges or a group files. Two replicas are compared from the root down, and
only children of nodes that differ are looked at, down to the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut

RANGE_BYTES, FILE_RECORDS, GROUP_FILES = 1 << 18, 1000, 1024
END = "\r\n\r\n"


def record(url: Column, body: Column, version: Column | None = None) -> Column:
    """A resource record without the two line ends that close it."""
    lines = F.lit("\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: ")
    body = F.coalesce(body, F.lit(""))
    return F.concat(version if version is not None else F.lit("WARC/1.0"), *lines, F.octet_length(body).cast("string"), F.lit(END), body)


def records(pages: DataFrame, version: Column | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(record_id, file, data) of every page: FILE_RECORDS consecutive ids to a file.

    Edge cases: a null url or body is written empty; a page without id goes to file -1; repeated rows
    are records each; further columns are left out.
    """
    n = F.col(id_col).cast("long")
    return pages.select(n.alias("record_id"), F.coalesce(F.expr(f"(cast(`{id_col}` as bigint) - pmod(cast(`{id_col}` as bigint), {FILE_RECORDS})) div {FILE_RECORDS}"), F.lit(-1)).cast("long").alias("file"), record(F.col(url_col).cast("string"), F.col(body_col).cast("string"), version).alias("data"))


def fixity(rows: DataFrame) -> DataFrame:
    """(record_id, file, offset, length, sha256) of records; length takes in the closing line ends. Texts don't move."""
    hashed = rows.select("record_id", "file", (F.octet_length("data") + len(END)).cast("long").alias("length"), F.sha2(F.concat("data", F.lit(END)), 256).alias("sha256"))
    before = Window.partitionBy("file").orderBy("record_id", "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.withColumn("offset", F.sum("length").over(before) - F.col("length")).select("record_id", "file", "offset", "length", "sha256")


def _node(order: str, *parts: str) -> Column:
    """The hash of a node's children: `part:part,part:part` in their order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[p for p in parts if p != order])))
    return F.sha2(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), ","), 256)


class Tree:
    """ranges (file, range, hash), files (grp, file, hash), groups (grp, hash) and root of a replica's fixity table."""

    def __init__(self, rows: DataFrame) -> None:
        self.records = cut(rows.withColumn("range", F.expr(f"offset div {RANGE_BYTES}")))
        self.ranges = cut(self.records.groupBy("file", "range").agg(_node("offset", "offset", "length", "sha256").alias("hash")))
        self.files = self.ranges.groupBy("file").agg(_node("range", "range", "hash").alias("hash")).withColumn("grp", F.floor(F.col("file") / GROUP_FILES))
        self.groups = self.files.groupBy("grp").agg(_node("file", "file", "hash").alias("hash"))
        self.root: str = self.groups.agg(_node("grp", "grp", "hash").alias("hash")).first().hash


def audit(one: Tree, two: Tree) -> DataFrame:
    """(record_id, file, offset, length, sha256, status) of every record of one or of both replicas that is not alike in them.

    status: corrupt (other hash at the same place), moved (same hash, other place), missing (in one
    only) or extra (in two only); the first four columns are those of `one` where it has the record.
    """

    def differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        return a.join(b.withColumnRenamed("hash", "other"), keys, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(keys)

    def below(a: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
        return a.join(bad, keys, "left_semi")

    if one.root == two.root:
        bad = one.ranges.limit(0).select("file", "range")
    else:
        bad = differ(one.groups, two.groups, ["grp"])
        bad = differ(below(one.files, bad, ["grp"]), below(two.files, bad, ["grp"]), ["grp", "file"]).select("file")
        bad = differ(below(one.ranges, bad, ["file"]), below(two.ranges, bad, ["file"]), ["file", "range"])
    # Of equal ids (repeated rows) the first goes with the first.
    nth = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("offset"))
    a, b = (below(t.records, bad, ["file", "range"]).withColumn("nth", nth) for t in (one, two))
    b = b.select("file", F.col("record_id").alias("id"), F.col("nth").alias("n"), *[F.col(c).alias(f"{c}_2") for c in ("offset", "length", "sha256")]).withColumnRenamed("file", "file_2")
    both = a.join(b, (a.file == b.file_2) & a.record_id.eqNullSafe(b.id) & (a.nth == b.n), "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("nth").isNull(), "extra").when(F.col("sha256") != F.col("sha256_2"), "corrupt").when(F.col("offset") != F.col("offset_2"), "moved")
    pick = [F.coalesce("record_id", "id").alias("record_id"), F.coalesce("file", "file_2").alias("file"), *[F.coalesce(c, f"{c}_2").alias(c) for c in ("offset", "length", "sha256")]]
    return both.select(*pick, status.alias("status")).where("status is not null")


def write_warc(rows: DataFrame, path: str) -> None:
    """Records (record_id, file, data) as WARC files, a folder file=N for each file, by Spark's own writer."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(parts, "file").sortWithinPartitions("file", "record_id", F.sha2(F.concat("data", F.lit(END)), 256))
    ordered.select("file", "data").write.partitionBy("file").option("lineSep", END).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[int, bytes, dict[str, str], bytes]]:
    """(offset, whole record, headers, body) of a file's records, by their Content-Length; bytes that are no record raise."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or head < 0:
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in data[at:head].decode(errors="replace").split("\r\n")[1:] if ": " in x)
        end = head + 4 + int(headers["Content-Length"])
        yield at, data[at : end + 4], headers, data[head + 4 : end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, sha256, url, body) of the records of all WARC files under path. A file is read by one task."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, at, len(raw), hashlib.sha256(raw).hexdigest(), headers.get("WARC-Target-URI", ""), body) for at, raw, headers, body in parse_warc(content.as_py())]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["file", "offset", "length", "sha256", "url", "body"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"file=(-?\d+)", 1).cast("long").alias("file"), "content").mapInArrow(run, "file long, offset long, length long, sha256 string, url string, body binary")


def replica(pages: DataFrame, damaged: Column, lost: Column, added: Column, id_col: str = "page_id") -> DataFrame:
    """A replica's records for a drill: those of pages, of which some are damaged (their first line has another version of the same length), some lost (so that what follows in their file has moved), and some are there again under an id of their own (-1000 less theirs)."""
    n = F.col(id_col).cast("long")
    kept = pages.where(~F.coalesce(lost, F.lit(False)))
    again = pages.where(added).withColumn(id_col, -F.lit(1000) - n)
    version = F.when(damaged, "WARC/1.1").otherwise("WARC/1.0")
    return records(kept, version, id_col).unionByName(records(again, None, id_col))


def fixity_report(pages: DataFrame, other: DataFrame) -> DataFrame:
    """The fixity table of pages' records, audited against other records (record_id, file, data).

    (page_id, file, offset, length, sha256, range_index, range_hash, root_hash, replica_root_hash, status) of
    every record of pages (ok, corrupt, moved or missing in the other replica) and of those that only the
    other one has (extra; their place is the one there, without a range_hash). A very long record is
    hashed where it lies and is a range by itself; null and repeated rows as in records and audit.
    """
    one, two = Tree(fixity(records(pages))), Tree(fixity(other))
    found = cut(audit(one, two))
    bad = found.where("status <> 'extra'").select("file", "offset", "status")
    rows = one.records.join(one.ranges.withColumnRenamed("hash", "range_hash"), ["file", "range"]).join(bad, ["file", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    extra = found.where("status = 'extra'").withColumns({"range": F.expr(f"offset div {RANGE_BYTES}"), "range_hash": F.lit(None).cast("string")})
    both = rows.unionByName(extra.select(rows.columns))
    return both.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "sha256", F.col("range").alias("range_index"), "range_hash", F.lit(one.root).alias("root_hash"), F.lit(two.root).alias("replica_root_hash"), "status")
