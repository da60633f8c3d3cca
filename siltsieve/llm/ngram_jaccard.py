"""Exact Jaccard join of documents on their word n-grams, as a blocked sparse matrix product.

The matrix has a row for each distinct set of n-grams and a column for each n-gram. The product of
the matrix with its transpose holds the overlaps of all pairs of rows; only those blocks of it are
computed whose rows can still reach the similarity, by their sizes and by the places of the columns
that they share.

1. Documents with equal sets are one row of the matrix from the start.
2. How many rows hold a column is counted over all rows; the most frequent columns, up to a fixed
   number of them, form a bounded broadcast table. Every row orders its columns alike: rare ones
   first, then frequent ones, each by hash. Two rows of similarity t share a column within their
   first n - ceil(t * n) + 1, so only those are dealt out, as lists by column.
3. A column's rows are first set against a few leaders among them (stars, linear in their number);
   overlap counts are summed by pair, and pairs that reach their bound are verified on whole
   sets; rows that are left outside a long column's largest component get more leaders from it.
4. Rows in one component need no comparison among themselves. All others are put into blocks of
   bounded size, by component where that is large, else by the longest column they share, and by
   size; a row without such company is a block by itself. Each column names the pairs of blocks that
   could hold a link, at the first column that they share as far as that can be told, and the
   product of two such blocks is computed in one task. What grows with a group of near copies is
   the number of its blocks, not that of its pairs, and a pair of blocks gives links between
   components, not between rows.

Frequent columns are dealt into blocks of rows, each with stars of its own, whose components then
meet by one row each; after that, rows outside such a column's largest component go to all its parts.

Hashes have 64 bits throughout (see wordhash). Similarity is compared in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..operators.graph import components
from ._shared import Scratch, byte_slices, evict, release, text_or_empty, text_slices, whole_keys
from .wordhash import Words, distinct, mix, shingles

SLICE_BYTES = 1 << 19
#: The table of frequent columns holds at most so many, and none with fewer rows than LEAST_FREQUENT.
MOST_FREQUENT, LEAST_FREQUENT = 1 << 20, 8
#: A frequent column with more rows is dealt into blocks of about so many.
BLOCK_ROWS = 20_000
#: Leaders of a column with more than LONG_LIST rows; others have one.
LEADERS, LONG_LIST = 8, 16
#: New leaders of such a column for rows that are not yet in its largest component.
MORE_LEADERS = 32
#: A leader leads in some of the columns that it shares with a row; it is tried from this part of the bound on.
SHARE = 2
#: A block holds about so many rows of the matrix, or fewer with about so many columns.
BLOCK, BLOCK_VALUES = 64, 1 << 16
#: A block that meets more than so many others does so in several tasks.
GUESTS = 512
#: A table of at most so many rows of a few numbers is broadcast, a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 19
#: About so many sets are dealt to tasks at once; more go in slices, MOST_SLICES of them at most, one after another.
DEALT_ROWS, MOST_SLICES = 1 << 19, 32
#: Rows and pairs that a task holds at once.
CHUNK, PAIRS_AT_ONCE = 1 << 17, 1 << 17
#: Names of sets that a task remembers, to send each once.
SEEN = 200_000
NO_ID = -(1 << 63)
#: Bits of the filter that says which rows' sets are wanted.
FILTER_BITS = 1 << 25


def need(a, b, percent: int):  # noqa: ANN001, ANN201
    """The least overlap o of sets of sizes a and b with 100 * o >= percent * (a + b - o)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int):  # noqa: ANN001, ANN201
    """n - ceil(percent / 100 * n) + 1."""
    return n + (-percent * n) // 100 + 1


class Sets:
    """The distinct n-grams of each text of a batch: `values` ascending within a text, `counts`, and a 64-bit name of each whole set."""

    def __init__(self, own: list[bytes], k: int) -> None:
        w = Words(own, lower=True)
        self.values, self.counts = distinct(*shingles(w.hashes, w.counts, k))
        self.begins = np.cumsum(self.counts) - self.counts
        self.names = np.zeros(len(own), np.int64)
        some = self.counts > 0
        if some.any():
            at = self.begins[some]
            total = np.add.reduceat(mix(self.values ^ np.uint64(0x2545F4914F6CDD1D)), at)
            self.names[some] = mix(total + self.counts[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.begins[i] : self.begins[i] + self.counts[i]]


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, Sets]]:
    evict()
    for batch in batches:
        for rows, own in text_slices(batch, SLICE_BYTES):
            yield rows, Sets(own, k)


#: Columns are counted by the first KEY_BITS of their hashes: PART_BITS give the part of the range, 32 are stored.
PART_BITS = 16
KEY_BITS = PART_BITS + 32


def count_columns(docs: DataFrame, k: int, parts: int) -> DataFrame:
    """(h, n) of every column in more than LEAST_FREQUENT documents; h: the first KEY_BITS of its hash.

    Columns travel as blocks of 32-bit numbers, one for each task and part of the hash range; equal
    sets within a task count once. Two columns with one key count as one, which costs no results.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) >> np.uint64(64 - KEY_BITS)
            held.clear()
            cuts = np.searchsorted(keys, np.arange(1, 1 << PART_BITS, dtype=np.uint64) << np.uint64(32))
            blocks = [(i, x) for i, x in enumerate(np.split(keys.astype(np.uint32), cuts)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], ["block", "data"])

        for _, s in sets_of(batches, k):
            new = []
            for name in s.names.tolist():
                new.append(name not in seen)
                seen.add(name)
            if len(seen) > SEEN:
                seen.clear()
            held.append(s.values[np.repeat(np.array(new), s.counts)])
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    def counts_of(i: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        n = np.diff(at, append=len(values))
        many = n > LEAST_FREQUENT
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(values[at[many]].astype(np.int64) + (i << 32)), pa.array(n[many].astype(np.int64))], ["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = -1, []  # one part of the range at a time
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != block and held:
                    yield from counts_of(block, held)
                    held = []
                block = i
                held.append(np.frombuffer(data, np.uint32))
        if held:
            yield from counts_of(block, held)

    rows = docs.mapInArrow(pack, "block int, data binary")
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(count, "h long, n long")


def frequent_columns(docs: DataFrame, k: int, parts: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers of rows) of the most frequent columns, MOST_FREQUENT at most, by key. Others may be frequent where there are more; that costs time, not results."""
    counts = scratch.cut(count_columns(docs, k, parts))
    by = {r.e: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()}  # a few dozen rows
    least, total = 64, 0
    for e in sorted(by, reverse=True):
        total += by[e]
        if total > MOST_FREQUENT:
            break
        least = e
    got = counts.where(F.floor(F.log2("n")) >= least).select("h", "n").toArrow()
    keys, n = (got.column(c).to_numpy() for c in ("h", "n"))
    scratch.drop(counts)
    order = np.argsort(keys)
    return keys[order].view(np.uint64), n[order]


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def postings(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:  # noqa: ANN001
    """(h, node, size, place, col, blocks) of the columns at the beginning of each row of the matrix.

    node: the set's name. A column with too many rows for one task is dealt into blocks by node:
    then col is the column and h stands for it and the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, n_rows), seen = frequent.value, set()
        for _, s in sets_of(batches, k):
            hot = is_in(s.values >> np.uint64(64 - KEY_BITS), table)
            rows: list[np.ndarray] = []
            nodes: list[int] = []
            for i, (n, name) in enumerate(zip(s.counts.tolist(), s.names.tolist(), strict=True)):
                if not n or name in seen:
                    continue
                seen.add(name)
                a, p = int(s.begins[i]), int(prefix_length(n, percent))
                own, mark = s.values[a : a + n], hot[a : a + n]
                first = own[~mark][:p]
                rows.append(first if len(first) == p else np.concatenate([first, own[mark][: p - len(first)]]))
                nodes.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if rows:
                lens = np.array([len(x) for x in rows])
                ends = np.cumsum(lens)
                place = np.arange(ends[-1]) - np.repeat(ends - lens, lens)
                h, node = np.concatenate(rows), np.repeat(s.names[nodes], lens)
                blocks = np.ones(len(h), np.int32)
                if len(table):
                    at = np.minimum(np.searchsorted(table, h >> np.uint64(64 - KEY_BITS)), len(table) - 1)
                    large = np.flatnonzero((table[at] == h >> np.uint64(64 - KEY_BITS)) & (n_rows[at] > BLOCK_ROWS))
                    blocks[large] = -(-n_rows[at[large]] // BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(np.repeat(s.counts[nodes], lens).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(blocks)], ["h", "node", "size", "place", "blocks"])

    rows = docs.mapInArrow(run, "h long, node long, size int, place int, blocks int")
    large = F.col("blocks") > 1
    return rows.select(F.when(large, block_key("h", F.pmod("node", "blocks"))).otherwise(F.col("h")).alias("h"), "node", "size", "place", F.when(large, F.col("h")).alias("col"), "blocks")


def block_key(column: str, block: Column) -> Column:
    return F.xxhash64(column, block.cast("int"))


def by_column(postings: DataFrame, parts: int) -> DataFrame:
    return postings.repartition(parts, "h").sortWithinPartitions("h")


class Lists:
    """Postings of whole columns, sorted by column, then by size and node; each node once a column. Null becomes 0."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        all_rows = pa.Table.from_batches(held)
        columns = {c: (x.fill_null(0) if x.null_count else x).to_numpy() for c, x in zip(all_rows.column_names, all_rows.columns, strict=True)}
        order = np.lexsort((columns["node"], columns["size"], columns["h"]))
        columns = {c: x[order] for c, x in columns.items()}
        new = np.ones(len(order), bool)
        new[1:] = (columns["h"][1:] != columns["h"][:-1]) | (columns["node"][1:] != columns["node"][:-1])
        self.columns = {c: x[new] for c, x in columns.items()}
        h = self.columns["h"]
        self.begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.lens = np.diff(self.begins, append=len(h))


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
    """A task's postings, which come by column (by_column), in chunks of whole columns; so memory follows CHUNK or the longest column."""
    return map(Lists, whole_keys(batches, "h", CHUNK))


def possible(size_a, place_a, size_b, place_b, percent: int):  # noqa: ANN001, ANN201
    """Whether rows of these sizes that share a column at these places, and none before, can be similar enough."""
    rest = np.minimum(size_a - place_a, size_b - place_b)
    return rest >= need(size_a, size_b, percent)


LISTED = "h long, node long, size int, place int, col long, blocks int, len long"


def shared_lists(postings: DataFrame, percent: int, parts: int) -> DataFrame:
    """Postings of columns that two rows or more have, with len, how many rows about the column has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in lists_of(batches):
            own = lists.columns
            keep = np.repeat(lists.lens > 1, lists.lens)
            # A row is of use only if the next smaller or larger one could reach it by size alone.
            size, h = own["size"].astype(np.int64), own["h"]
            near = np.zeros(len(h), bool)
            ok = (h[1:] == h[:-1]) & (100 * size[:-1] >= percent * size[1:])
            near[1:] |= ok
            near[:-1] |= ok
            keep &= near
            keep |= own["blocks"] > 1  # others may be in another block
            if keep.any():
                own["len"] = np.repeat(lists.lens, lists.lens) * own["blocks"]
                yield pa.RecordBatch.from_arrays([pa.array(own[c][keep], mask=(own["blocks"][keep] < 2) if c == "col" else None) for c in ("h", "node", "size", "place", "col", "blocks", "len")], ["h", "node", "size", "place", "col", "blocks", "len"])

    return by_column(postings, parts).mapInArrow(run, LISTED)


PAIRS = "a long, b long, size_a long, size_b long, c long, led long"


def pair_batch(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> pa.RecordBatch:
    """(a, b, size_a, size_b, c, led) of pairs, a < b, each once with how often it stands there, and how often a comes as x."""
    swap = x > y
    a, b, size_a, size_b = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, size_y, size_x), np.where(swap, size_x, size_y)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    led = np.add.reduceat((~swap[order]).astype(np.int64), at)
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (a[at], b[at], size_a[order][at], size_b[order][at], np.diff(at, append=len(a)), led)], ["a", "b", "size_a", "size_b", "c", "led"])


def overlapping(pairs: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """(home, guest) of pairs whose shared columns, summed up, reach the bound by size; home: the one that more often led.

    c counts the columns that both rows have in their beginnings. Say that the beginning of x ends
    first; every shared column up to there is counted, and x has size - prefix more. So of the
    overlap that the sizes need, c must be what the larger of the two rests leaves. share: where
    only some columns were counted for a pair, the bound is divided by it.
    """
    total = pairs.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("c").alias("c"), F.sum("led").alias("led"))
    both, large = F.expr(f"{percent} * (size_a + size_b)"), F.expr(f"{percent} * greatest(size_a, size_b)")
    up = lambda x, n: F.floor((x + n - 1) / n)  # noqa: E731  exact far beyond any text's size
    return total.where(share * F.col("c") >= up(both, 100 + percent) - up(large, 100) + 1).select(*by_lead())


def by_lead() -> list[Column]:
    first = 2 * F.col("led") >= F.col("c")
    return [F.when(first, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest")]


def star_pairs(lists: DataFrame, percent: int, parts: int, again: int = 0, turns: int = 1) -> DataFrame:
    """PAIRS of each column's rows with a few leaders that they could be similar to, chosen alike in all columns: the rows whose names come first in a few random orders.

    again: for a later round, the number of new leaders of each long list, for lists with a column
    `component`; they come from the list's largest component and are set against rows of others.
    turns: in each long list, only one of so many leaders leads, by the list's hash. That is for rows that
    share many lists, whose pairs would stand in each of them; what stars leave apart meets in blocks.
    """

    def pairs_of(lists: Lists) -> Iterator[pa.RecordBatch]:
        node, size, place = (lists.columns[c].astype(np.int64) for c in ("node", "size", "place"))
        part = lists.columns["component"] if again else None
        turn = (mix(lists.columns["h"][lists.begins].view(np.uint64)) % np.uint64(turns)).astype(np.int64)
        batch_of = lambda x, y: pair_batch(node[x], node[y], size[x], size[y])
        long = lists.lens > LONG_LIST
        main = np.zeros(len(node), bool)
        if again:
            for a, n in zip(lists.begins[long].tolist(), lists.lens[long].tolist(), strict=True):
                names, count = np.unique(part[a : a + n], return_counts=True)
                main[a : a + n] = part[a : a + n] == names[np.argmax(count)]
        x, y, held = [], [], 0
        for r in range(LEADERS, LEADERS + again) if again else range(LEADERS):
            rank = mix(node.view(np.uint64) + np.uint64((r * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
            which = np.flatnonzero(long & (turn == r % turns) | (r == 0) & ~long & (lists.lens > 1))
            if not len(which):
                continue
            begins, lens = lists.begins[which], lists.lens[which]
            offsets = np.cumsum(lens) - lens
            at = np.arange(lens.sum()) + np.repeat(begins - offsets, lens)  # rows of these lists
            if again:
                rank = np.where(main, rank, np.uint64(0xFFFFFFFFFFFFFFFF))
            least = np.minimum.reduceat(rank[at], offsets)
            own = np.flatnonzero(rank[at] == np.repeat(least, lens))
            own = own[np.unique(np.searchsorted(offsets, own, "right"), return_index=True)[1]]
            leader = np.repeat(at[own], lens)
            ok = (leader != at) & possible(size[at], place[at], size[leader], place[leader], percent)
            if again:
                ok &= part[leader] != part[at]
            x.append(leader[ok])
            y.append(at[ok])
            held += len(x[-1])
            if held > PAIRS_AT_ONCE:
                yield batch_of(np.concatenate(x), np.concatenate(y))
                x, y, held = [], [], 0
        if held:
            yield batch_of(np.concatenate(x), np.concatenate(y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in lists_of(batches):
            yield from pairs_of(some)

    return by_column(lists, parts).mapInArrow(run, PAIRS)


def leaders(lists: DataFrame) -> DataFrame:
    """One row of each component for each column that is dealt into blocks, so that components meet across blocks. lists has a column `component`."""
    one = lists.where("col is not null").groupBy("col", "component").agg(F.min(F.struct("node", "size", "place")).alias("x"))
    return one.select(F.col("col").alias("h"), "x.node", "x.size", "x.place")


def units(lists: DataFrame) -> DataFrame:
    """(node, component, block, n): the block of each row of the matrix, and how many rows about it has. lists has a column `component`."""
    own = lists.groupBy("node").agg(F.max("component").alias("component"), F.max("size").alias("size"), F.max(F.struct("len", F.coalesce("col", "h").alias("h"))).alias("long"))
    large = own.groupBy("component").agg(F.count("*").alias("of")).where(F.col("of") > LONG_LIST)
    key = F.when(F.col("of").isNotNull(), F.xxhash64("component", F.lit(0))).when(F.col("long.len") > LONG_LIST, F.xxhash64("long.h", F.lit(1)))
    own = own.join(large, "component", "left").select("node", "component", "size", key.alias("key"), F.floor(F.log("size") / math.log(1.25)).cast("int").alias("bucket"))
    some = own.where("key is not null")
    k = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_VALUES))
    total = some.groupBy("key", "bucket").agg(F.count("*").alias("of"), k.alias("k"))
    some = some.join(total, ["key", "bucket"]).select("node", "component", F.xxhash64("key", "bucket", F.pmod(F.xxhash64("node"), "k")).alias("block"), F.ceil(F.col("of") / F.col("k")).cast("int").alias("n"))
    return some.unionByName(own.where("key is null").select("node", "component", F.col("node").alias("block"), F.lit(1).alias("n")))


def dealt(lists: DataFrame, unit: DataFrame) -> DataFrame:
    """lists with their units, prev (the column before in the row, or null), minor and home.

    In a column of several parts, rows outside its largest component are minor and go to every part;
    home: the part where two units of such rows meet.
    """
    before = F.lag(F.coalesce("col", "h")).over(Window.partitionBy("node").orderBy("place", F.coalesce("col", "h")))
    rows = lists.withColumn("prev", before).join(unit, "node")
    columns = ["node", "size", "place", "prev", "component", "block", "n"]
    whole = rows.where("col is null").select("h", *columns, F.lit(False).alias("minor"), F.lit(True).alias("home"))
    split = rows.where("col is not null")
    sizes = split.groupBy("col", "component").agg(F.count("*").alias("of"))
    major = sizes.groupBy("col").agg(F.max(F.struct("of", "component")).alias("m"), F.count("*").alias("k")).where("k > 1").select("col", F.col("m.component").alias("major"))
    split = split.join(major, "col").withColumn("minor", F.col("component") != F.col("major"))
    to = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod("node", "blocks").cast("int")))
    split = split.withColumn("to", F.explode(to))
    return whole.unionByName(split.select(block_key("col", F.col("to")).alias("h"), *columns, "minor", (F.col("to") == F.pmod("block", "blocks")).alias("home")))


def block_pairs(lists: DataFrame, percent: int, parts: int) -> DataFrame:
    """(home, guest) of blocks that rows of different components in one column may link; home: the larger one. lists: as dealt() gives them.

    Bounds are taken over a block's rows in the column, so none is missed. Where all of both blocks'
    rows also share the column before, they met there and are left out.
    """

    def pairs_of(lists: Lists) -> Iterator[pa.RecordBatch]:
        own = lists.columns
        order = np.lexsort((own["block"], own["h"]))
        h, block = own["h"][order], own["block"][order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1])]))
        h, block, n = h[at], block[at], own["n"][order][at]
        size, place = (own[c][order].astype(np.int64) for c in ("size", "place"))
        least, most, rest = np.minimum.reduceat(size, at), np.maximum.reduceat(size, at), np.maximum.reduceat(size - place, at)
        part, prev = (own[c][order] for c in ("component", "prev"))
        part, other = np.minimum.reduceat(part, at), np.maximum.reduceat(part, at)
        prev, prev_other = np.minimum.reduceat(prev, at), np.maximum.reduceat(prev, at)
        minor, home = np.logical_and.reduceat(own["minor"][order], at), own["home"][order][at]
        ends = np.searchsorted(h, h, "right")
        many = ends - np.arange(len(h))  # partners of each unit, itself included
        steps = np.cumsum(many)
        a = 0
        while a < len(h):
            b = max(a + 1, int(np.searchsorted(steps, (steps[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
            x = np.repeat(np.arange(a, b), many[a:b])
            y = np.arange(len(x)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + x
            a = b
            ok = (part[x] != part[y]) | (part[x] != other[x]) | (part[y] != other[y])
            x, y = x[ok], y[ok]
            ok = (100 * most[x] >= percent * least[y]) & (100 * most[y] >= percent * least[x]) & (np.minimum(rest[x], rest[y]) >= need(least[x], least[y], percent))
            ok &= (prev[x] == 0) | (prev[x] != prev_other[x]) | (prev[x] != prev[y]) | (prev[x] != prev_other[y])
            ok &= ~(minor[x] & minor[y]) | np.where(block[x] <= block[y], home[x], home[y])
            x, y = x[ok], y[ok]
            if len(x):
                first = (n[x] > n[y]) | ((n[x] == n[y]) & (block[x] <= block[y]))
                pairs = np.unique(np.stack([np.where(first, block[x], block[y]), np.where(first, block[y], block[x])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["home", "guest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in lists_of(batches):
            yield from pairs_of(some)

    return by_column(lists, parts).mapInArrow(run, "home long, guest long").distinct()


def wanted_filter(nodes: DataFrame) -> np.ndarray:
    """A bit set of fixed size over the hashes of nodes: partial sets are joined in the tasks, a fixed number comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)] = True
        if bits.any():
            packed = np.packbits(bits).reshape(64, -1)
            some = [i for i in range(64) if packed[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(x, np.uint8)
                got[i] = got[i] | own if i in got else own
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((64, FILTER_BITS // 8 // 64), np.uint8)
    for r in nodes.mapInArrow(run, "part int, bits binary").repartition(16, "part").mapInArrow(join, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def sets_wanted(docs: DataFrame, k: int, wanted) -> DataFrame:  # noqa: ANN001
    """(doc_id, key, size, node, at, data) of every document; data: its set, where the filter wants it (once for equal sets in a task), at: a number for each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, n_sets = wanted.value, TaskContext.get().partitionId() << 40
        seen: set[int] = set()
        for rows, s in sets_of(batches, k):
            at = mix(s.names.view(np.uint64)) % np.uint64(FILTER_BITS)
            hit = (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
            data: list[bytes | None] = []
            for i, (name, h, n) in enumerate(zip(s.names.tolist(), hit.tolist(), s.counts.tolist(), strict=True)):
                data.append(s.of(i).tobytes() if h and n and name not in seen else None)
                if data[-1]:
                    seen.add(name)
            if len(seen) > SEEN:
                seen.clear()
            numbers = n_sets + np.arange(len(data))
            n_sets += len(data)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(s.counts.astype(np.int64)), pa.array([x if n else None for x, n in zip(s.names.tolist(), s.counts.tolist(), strict=True)], pa.int64()), pa.array(numbers), pa.array(data, pa.binary())], ["doc_id", "key", "size", "node", "at", "data"])

    return docs.mapInArrow(run, "doc_id long, key long, size long, node long, at long, data binary")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, marked to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Block:
    """Rows of the matrix, by column."""

    def __init__(self, rows: list[tuple[int, bytes]]) -> None:
        sets = [np.frombuffer(data, np.uint64) for _, data in rows]
        self.component = np.array([c for c, _ in rows], np.int64)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.columns, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)[np.argsort(at, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.columns)))])

    def links(self, component: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(component, component) of similar rows, each two once a step."""
        k = len(self.sizes)
        step = max(1, min(len(sets), ((1 << 20) // k) // max(1, int(max(len(x) for x in sets)))))
        for a in range(0, len(sets), step):
            some = sets[a : a + step]
            sizes = np.array([len(x) for x in some], np.int64)
            values, guest = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
            at = np.minimum(np.searchsorted(self.columns, values), len(self.columns) - 1)
            ok = self.columns[at] == values
            at, guest = at[ok], guest[ok]
            n = self.starts[at + 1] - self.starts[at]
            row = self.row[np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)]
            both = np.bincount(np.repeat(guest, n) * k + row, minlength=len(some) * k).reshape(len(some), k)
            i, j = np.nonzero((100 + percent) * both >= percent * (sizes[:, None] + self.sizes))
            x, y = component[a : a + step][i], self.component[j]
            if (differ := x != y).any():
                got = np.unique(np.stack([np.minimum(x, y)[differ], np.maximum(x, y)[differ]], 1), axis=0)
                yield got[:, 0], got[:, 1]


@dataclass
class Rows:
    """Of all documents: (doc_id, key, size, node), the sets (at, data) of those that stand in lists, and (node, at) of one set of each node."""

    docs: DataFrame
    sets: DataFrame
    first: DataFrame


def verified(pairs: DataFrame, rows: Rows, percent: int, parts: int, scratch: Scratch, members: DataFrame | None = None) -> DataFrame:
    """(a, b): components that similar rows of two blocks link. pairs: (home, guest); members: (block, node, component), or None where blocks are single rows.

    A home's rows come once to a task, and its guests stream past them, so memory follows a block,
    not the number of pairs; a home with many guests is dealt over several tasks.

    What moves until the last step are numbers; there each set that is needed is read where it lies and
    sent straight to its tasks. Homes are taken in slices, so that disk follows DEALT_ROWS or a slice of
    what has to meet, not all of it.
    """
    pairs = scratch.cut(pairs)
    at = ["home", "salt"]
    homes = pairs.groupBy("home").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("k"))
    guests = pairs.join(homes, "home").select("home", F.pmod(F.xxhash64("guest"), "k").cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("guest").alias("block"))
    homes = homes.select("home", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("home").alias("block"))
    meet = scratch.cut(homes.unionByName(guests))
    if members is None:
        dealt = n = meet.count()
    else:
        of = members.groupBy("block").agg(F.count("*").alias("of"))
        n, dealt = meet.join(of, "block").agg(F.count("*"), F.coalesce(F.sum("of"), F.lit(0))).first()
    slices = min(MOST_SLICES, max(1, -(-dealt // DEALT_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, block = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            begins = np.flatnonzero(new).tolist()
            for a, b in zip(begins, [*begins[1:], batch.num_rows]):
                own, data = batch.column(3)[a:b].to_numpy(), batch.column(4)[a:b].to_pylist()
                if (keys[0][a], keys[1][a]) != now:
                    now, rows, block = (keys[0][a], keys[1][a]), [], None
                if not keys[2][a]:
                    rows += zip(own.tolist(), data, strict=True)
                    continue
                block = block or Block(rows)
                for x, y in byte_slices([len(d) for d in data], SLICE_BYTES):
                    for got in block.links(own[x:y], [np.frombuffer(d, np.uint64) for d in data[x:y]], percent):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in got], ["a", "b"])

    out = None
    for i in range(slices):
        now = meet.where(F.pmod(F.xxhash64(*at), F.lit(slices)) == i) if slices > 1 else meet
        used = now.select("block").distinct()
        own = used.withColumns({"node": F.col("block"), "component": F.col("block")}) if members is None else members.join(few(used, n // slices), "block", "left_semi")
        # Of equal sets that several tasks wrote, one is read.
        own = scratch.cut(own.join(rows.first, "node").select("at", "block", "component"))
        both = rows.sets.join(few(own, own.count()), "at").join(few(now, n // slices), "block").select(*at, "kind", "component", "data")
        got = scratch.cut(both.repartition(parts, *at).sortWithinPartitions(*at, "kind").mapInArrow(run, "a long, b long").distinct())
        out = got if out is None else out.unionByName(got)
        scratch.drop(own)
        release(meet.sparkSession)
    scratch.drop(meet)
    return out


def rows_of(docs: DataFrame, k: int, lists: DataFrame, scratch: Scratch) -> Rows:
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_filter(lists.select("node")))
    rows = scratch.cut(sets_wanted(docs, k, wanted))
    wanted.unpersist()
    some = rows.where("data is not null")
    return Rows(rows.select("doc_id", "key", "size", "node"), some.select("at", "data"), scratch.cut(some.groupBy("node").agg(F.min("at").alias("at"))))


def linked_components(rows: Rows, lists: DataFrame, stars: Callable[[DataFrame], DataFrame], percent: int, parts: int, scratch: Scratch, turns: int = 1) -> DataFrame:
    """(node, component) of all nodes with links. lists: as shared_lists() gives them; stars: (home, guest) of PAIRS that are worth a comparison; turns: as in star_pairs()."""
    links = verified(stars(star_pairs(lists, percent, parts, turns=turns)), rows, percent, parts, scratch)
    known = components(links)

    def labelled() -> DataFrame:
        return lists.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def more(pairs: DataFrame, members: DataFrame | None = None) -> None:
        nonlocal links, known
        got = verified(pairs, rows, percent, parts, scratch, members)
        if not got.isEmpty():
            links = links.unionByName(got)
            known = components(links)

    more(stars(star_pairs(labelled(), percent, parts, MORE_LEADERS, turns)))
    if not lists.where("col is not null").isEmpty():
        more(stars(star_pairs(leaders(labelled()), percent, parts)))
    unit = scratch.cut(units(labelled()))
    more(block_pairs(dealt(lists, unit), percent, parts), unit.select("block", "node", "component"))
    return known


def named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component, component_id) of each node of rows (doc_id, size, node) with several documents or with links; found: (node, component) of nodes with links."""
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    groups = least.join(found, "node", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    return groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, key); key: a hash of the text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def ngram_rows(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, key, size, node, component, component_id) of every row of docs, which is as keyed() gives it.

    node: the name of its set, null without words; component: that of its component, null where it is alone.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = spark.sparkContext.broadcast(frequent_columns(docs, k, parts, scratch))
    release(spark)
    lists = scratch.cut(shared_lists(postings(docs, k, percent, frequent), percent, parts))
    frequent.unpersist()
    release(spark)
    rows = rows_of(docs, k, lists, scratch)
    found = linked_components(rows, lists, lambda pairs: overlapping(pairs, percent, SHARE), percent, parts, scratch)
    names = scratch.cut(named(rows.docs, found))
    out = scratch.cut(rows.docs.join(few(names, names.count()), "node", "left").select("doc_id", "key", "size", "node", "component", F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.drop(but=out)
    return out


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    Two rows link when 100 * |A and B| >= percent * |A or B| for their sets of distinct k-word
    shingles, A-Z lower-cased; a text of fewer words has its whole sequence as its only one.
    component_id: the smallest id that links reach, its own included.

    Edge cases: a null text and one without words have an empty set and link with nothing; repeated
    rows are rows with equal sets; a null id is kept, in a component by its other rows; a very long
    text is a row of its size; an empty table gives an empty result; further columns are left out.
    """
    rows = ngram_rows(keyed(docs, id_col, text_col), k, percent, Scratch(docs.sparkSession))
    return rows.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component of ngram_jaccard one row stays, that of the smallest id (a null id first), of equal ids that of the smallest hash of its text.

    Edge cases: rows are told apart by id and text, so rows of one id with different texts stand for
    themselves; of rows that are equal in both, one stays; texts without words all stay; all columns
    are kept, also those with names used here.
    """
    scratch = Scratch(docs.sparkSession)
    rows = ngram_rows(keyed(docs, id_col, text_col), k, percent, scratch).where("component is not null")
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key")
    rows = rows.select(place.alias("place"), "component")
    chosen = rows.groupBy("component").agg(F.min("place").alias("chosen"))
    rows = rows.groupBy("component", "place").agg(F.count("*").alias("n")).join(chosen, "component")
    at, own, stays = fresh(docs.columns, "at", "own", "stays")
    # Nothing to do for a chosen row that stands once.
    rows = scratch.cut(rows.select(F.col("place.id").alias(at), F.col("place.key").alias(own), (F.col("place") == F.col("chosen")).alias(stays), "n").where(~F.col(stays) | (F.col("n") > 1)).drop("n"))
    marked = docs.withColumns({at: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), own: F.xxhash64(text_or_empty(text_col))})
    marked = marked.join(few(rows, rows.count()), [at, own], "left")
    once = marked.where(F.col(stays).isNull())
    if not rows.where(stays).isEmpty():
        once = once.unionByName(marked.where(stays).dropDuplicates([at, own]))
    return once.select(docs.columns)
