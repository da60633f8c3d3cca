"""Removal of passages that stand elsewhere before, by hashes of runs of consecutive sentences.

A sentence ends with `.`, `!` or `?` before white space, or at a line end. One of more than LONG
words is cut further, before the word with the least hash of every LONG consecutive words in it (the
last of equal ones), so that text without punctuation has pieces, too, and the same ones in every
copy. A span is the shortest run of at least MIN_SENTENCES pieces and MIN_WORDS words from a piece
on. Spans are joined globally by hash; the first of equal spans, by document and place, stays, and
all pieces that any later one covers go. The first place of a piece is never covered by a later span,
so nothing is lost altogether.

Any MIN_WORDS + 2 * LONG words that stand in two places hold a common span, wherever they begin and
end: no piece is longer than LONG, so there is a cut in the first LONG words that both places have, and
one in the last LONG; where the places' other cuts differ, near the ends, these don't come between.

Before the shuffle, every batch keeps its own first of equal spans and reports the later ones at
once, so a passage that is in a third of all documents sends a row a batch, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh
from ._shared import evict, text_or_empty, text_slices, whole_keys
from .wordhash import BASE, SPACE, Words, mix

SLICE_BYTES, CHUNK, ROWS = 1 << 20, 1 << 18, 500
#: 20 + 2 * 15 = 50 words.
MIN_SENTENCES, MIN_WORDS, LONG = 2, 20, 15
NO_ID = -(1 << 63)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_QUOTES = np.zeros(256, bool)
_QUOTES[list(b"\"')]")] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence, text of each sentence) of a batch."""
    n = len(w.starts)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    space = SPACE[w.data]
    word_ends = np.flatnonzero(~space[:-1] & space[1:])  # last byte of each word
    last = w.data[word_ends]
    before = w.data[np.maximum(word_ends - 1, w.starts)]
    lines = np.cumsum(w.data == 10)
    following = np.append(w.starts[1:], len(w.data) - 1)
    end = _ENDS[last] | (_QUOTES[last] & _ENDS[before]) | (lines[following] > lines[word_ends])
    end[np.cumsum(w.counts)[w.counts > 0] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], end[:-1]])) if n else np.zeros(0, np.int64)
    lens = np.diff(first, append=n)
    # Places where LONG words of one long sentence begin.
    left = np.repeat(first + lens, lens) - np.arange(n)
    begins = np.flatnonzero(np.repeat(lens > LONG, lens) & (left >= LONG))
    for a in range(0, len(begins), 1 << 16):
        some = begins[a : a + (1 << 16)]
        least = some + LONG - 1 - w.hashes[some[:, None] + np.arange(LONG - 1, -1, -1)].argmin(axis=1)
        end[least[least > 0] - 1] = True
    first = np.flatnonzero(np.concatenate([[True], end[:-1]])) if n else first
    return first, text[first]


def spans(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first byte, end byte) of every span of a batch; bytes count from the text's start, white space after a sentence belongs to it."""
    w = Words(own)
    words = len(w.starts)
    none = np.zeros(0, np.int64)
    if not words:
        return np.zeros(0, np.uint64), none, none, none
    # With a polynomial over all words before each one, that of any run is a difference, moved to place 0.
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(words, BASE, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(words, INVERSE, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hashes * up[:-1], dtype=np.uint64)])
    starts = np.append(w.starts, 0)
    begins = w.ends - np.array([len(t) + 1 for t in own])
    first, text = sentences(w)
    n = len(first)
    sentence_end = first + np.diff(first, append=words)
    last_of_text = np.searchsorted(text, np.arange(len(own)), "right")[text]  # end of the text's sentences
    to = np.maximum(np.arange(n) + MIN_SENTENCES, np.searchsorted(sentence_end, first + MIN_WORDS, "left") + 1)
    ok = np.flatnonzero(to <= last_of_text)
    a, b = first[ok], sentence_end[to[ok] - 1]
    total = (sums[b] - sums[a]) * down[a]
    end_byte = np.where(to[ok] < last_of_text[ok], starts[np.minimum(b, words)], w.ends[text[ok]] - 1)
    begin_of = begins[text[ok]]
    return mix(total), text[ok], w.starts[a] - begin_of, end_byte - begin_of


def firsts(h: np.ndarray, doc: np.ndarray, key: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, document and place; which of these are the first of their hash)."""
    order = np.lexsort((begin, key, doc, h))
    return order, np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(order) else np.zeros(0, bool)


def later_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, key, begin, end) of every span that is not the first with its hash. rows: doc_id, key, text."""
    schema = "h long, doc_id long, key long, begin int, end int, later boolean"

    def batch_of(h, doc, key, begin, end, later) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(key), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(later)], ["h", "doc_id", "key", "begin", "end", "later"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        for batch in batches:
            parts = []
            for some, own in text_slices(batch, SLICE_BYTES):
                h, text, begin, end = spans(own)
                parts.append((h, some.column(0).to_numpy()[text], some.column(1).to_numpy()[text], begin, end))
            if parts:
                h, doc, key, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
                order, first = firsts(h, doc, key, begin)
                # Equal rows are one place.
                same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & (begin[order][1:] == begin[order][:-1])]) if len(order) else first
                order, later = order[~same], ~first[~same]
                yield batch_of(h[order], doc[order], key[order], begin[order], end[order], later)

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        h, doc, key, begin, end = (t.column(c).to_numpy() for c in ("h", "doc_id", "key", "begin", "end"))
        order, first = firsts(h, doc, key, begin)
        h, doc, key, begin, end = (x[order] for x in (h, doc, key, begin, end))
        # The same place comes twice from rows that are repeated.
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (begin[1:] == begin[:-1])])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        place_of_first = (doc == doc[lead]) & (key == key[lead]) & (begin == begin[lead])
        out = ~first & ~again & ~place_of_first
        if out.any():
            yield batch_of(h[out], doc[out], key[out], begin[out], end[out], np.ones(int(out.sum()), bool))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans come by hash, so a task holds CHUNK of them or those of one hash, of which each batch of texts sends one."""
        done: list[pa.RecordBatch] = []

        def open_ones() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                later = batch.column(5)
                if later.true_count:
                    done.append(batch.filter(later))
                yield batch.filter(pc.invert(later))

        for held in whole_keys(open_ones(), "h", CHUNK):
            yield from joined(held)
            yield from done
            done.clear()
        yield from done

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Spans that are known to be later ones don't need their hash's task.
    to = F.when(F.col("later"), F.xxhash64("doc_id", "begin", "h")).otherwise(F.col("h"))
    got = rows.mapInArrow(hashed, schema).withColumn("to", to).repartition(parts, "to").drop("to").sortWithinPartitions("h")
    return got.mapInArrow(split, schema).select("doc_id", "key", "begin", "end")


def merged(begin: list[int], end: list[int]) -> list[tuple[int, int]]:
    """Intervals as few disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(begin, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, and removed array<struct<begin, end>>: byte ranges of the old text, disjoint, in order.

    Edge cases: a null text stays null; a text of fewer sentences or words than a span needs stays
    as it is; repeated rows (equal id and text) are one place and keep the same text; rows of equal
    ids and other texts are told apart by the texts' hash; a null id comes first in the order; all
    other columns are kept, but for one named `removed`, which is replaced; a very long text is cut into
    sentences whole, as a slice by itself; an empty table gives an empty result.
    """
    key, doc = F.xxhash64(text_or_empty(text_col)), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(doc.alias("doc_id"), key.alias("key"), text_or_empty(text_col).alias("text"))
    columns = [c for c in docs.columns if c != "removed"]
    at_doc, at_key, found = fresh(docs.columns, "doc", "key", "spans")
    later = later_spans(rows).groupBy(F.col("doc_id").alias(at_doc), F.col("key").alias(at_key)).agg(F.collect_list(F.struct("begin", "end")).alias(found))
    both = docs.select(*columns).withColumns({at_doc: doc, at_key: key}).join(later, [at_doc, at_key], "left").select(*columns, found)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    at = columns.index(text_col)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            own, found = batch.column(at).cast(pa.large_binary()).to_pylist(), batch.column(len(columns)).to_pylist()
            gone = []
            for i, got in enumerate(found):
                ranges = merged([x["begin"] for x in got], [x["end"] for x in got]) if got else []
                gone.append([{"begin": a, "end": b} for a, b in ranges])
                if ranges:
                    edges = [0, *[x for r in ranges for x in r], len(own[i])]
                    own[i] = b"".join(own[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out = [batch.column(i) for i in range(len(columns))]
            out[at] = pa.array(own, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array(gone, kind)], [*columns, "removed"])

    return both.mapInArrow(strip, f"{fields}, removed array<struct<begin: long, end: long>>")
