"""Toxicity by the nearest labelled examples, in exact TF-IDF cosine, with votes weighted by similarity.

1. A bounded sample of labelled rows gives the examples. Terms are words and their first 4 bytes.
   Every term of an example is indexed, and every term of a text counts in its norm; how much the
   labels lean on a term is a factor of its weight, never 0. A term that no example has counts as one
   that is in a document for each sample of this size.
2. Document frequencies of all indexed terms are counted over all documents.
3. The examples' TF-IDF vectors form an inverted index, by term, in blocks of examples that are alike;
   for each term and block the largest weight is kept. These give a bound of a text's similarity to
   any example of a block. The blocks of the highest bounds are compared first, then all whose bound
   reaches the k-th best similarity found there, so the neighbours are exact. Terms of many examples
   have full rows, so that a block meets many texts in one matrix product; the others have lists.
4. The k nearest vote with the square of their similarity. Votes turn into probabilities by a
   logistic curve that is fitted to the examples' own votes, each without itself.

The examples are bounded in number, so the index is broadcast. Only texts are inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, evict, text_or_empty, text_slices, texts
from .wordhash import Words

SLICE_BYTES = 1 << 19
#: Bound of the sample of labelled rows.
MOST_EXAMPLES = 4096
#: Examples of a block; blocks that every text is compared with.
BLOCK, FIRST = 64, 2
#: Document counts travel in parts of so many terms.
PART = 4096
#: A term's weight is multiplied by LEAST_FACTOR + r / (r + HALF ** 2), r the square of its correlation with the label.
LEAST_FACTOR, HALF = 0.05, 0.117
#: Terms of at least one in FULL examples have full rows; so many texts are compared at once.
FULL, TEXTS = 16, 32
NEIGHBOURS, SHOWN, THRESHOLD = 16, 3, 0.7
PREFIXES = (4,)
BETWEEN = np.ones(256, bool)
BETWEEN[0x80:] = False
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def distinct_terms(own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, how often) of every term of each text, by text and hash."""
    w = Words(own, lower=True, between=BETWEEN, prefixes=PREFIXES)
    words, first, word = np.unique(w.hashes, return_index=True, return_inverse=True)
    kinds = [words, *(h[first] for h in w.prefixes)]
    seen, term = np.unique(np.concatenate(kinds), return_inverse=True)
    text, size = np.repeat(np.arange(len(own)), w.counts), max(len(seen), 1)
    key, often = np.unique(np.concatenate([text * size + t[word] for t in term.reshape(len(kinds), -1)]), return_counts=True)
    return key // size, seen[key % size], often


def find(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in sorted_, or -1."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


class Postings:
    """A term x example matrix by lists: of term t, example[starts[t]:starts[t + 1]] and their weights. [terms]: those rows in full."""

    def __init__(self, term: np.ndarray, example: np.ndarray, often: np.ndarray, idf: np.ndarray, norm: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.example, self.often, self.idf, self.norm = example[order].astype(np.int16), often[order].astype(np.int32), idf, norm
        self._weight = None

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.idf), len(self.norm)

    @property
    def weight(self) -> np.ndarray:
        if self._weight is None:
            out = np.repeat(self.idf, np.diff(self.starts)).astype(np.float32)
            for a in range(0, len(out), 1 << 19):
                b = slice(a, a + (1 << 19))
                out[b] *= (1 + np.log(self.often[b])) / self.norm[self.example[b]]
            self._weight = out
        return self._weight

    def __getstate__(self) -> tuple:
        # Spark keeps a file of it on every executor.
        parts = np.diff(self.example, prepend=np.int16(0)), self.often, np.diff(self.starts)
        return [(pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True), x.dtype, len(x)) for x in parts], self.idf, self.norm

    def __setstate__(self, state: tuple) -> None:
        parts, self.idf, self.norm = state
        got = [np.ascontiguousarray(np.frombuffer(pa.decompress(x, n * d.itemsize, "zstd", asbytes=True), np.uint8).reshape(d.itemsize, n).T).view(d).reshape(n) for x, d, n in parts]
        self.example, self.often, self.starts = np.cumsum(got[0], dtype=np.int16), got[1], np.concatenate([[0], np.cumsum(got[2])])
        self._weight = None

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the terms' lists, one after the other; length of each)."""
        n = self.starts[term + 1] - self.starts[term]
        return np.repeat(self.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def __getitem__(self, term: np.ndarray) -> np.ndarray:
        at, n = self.lists(np.asarray(term))
        out = np.zeros((len(n), self.shape[1]), np.float32)
        out[np.repeat(np.arange(len(n)), n), self.example[at]] = self.weight[at]
        return out

    def __array__(self, dtype=None, copy=None) -> np.ndarray:  # noqa: ANN001
        return self[np.arange(self.shape[0])].astype(dtype or np.float32)


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Blocks:
    """Block maxima of postings. Of terms with full rows (place: their number or -1): full[block, row, example] and top[row, block]; of others: entries of one term and block, with their postings and the largest weight."""

    def __init__(self, p: Postings) -> None:
        terms, examples = p.shape
        self.n = max(1, -(-examples // BLOCK))
        lens = np.diff(p.starts)
        long = np.flatnonzero(lens * FULL >= max(examples, 1))
        self.place = np.full(terms, -1)
        self.place[long] = np.arange(len(long))
        full = np.zeros((len(long), self.n * BLOCK), np.float32)
        full[:, :examples] = p[long]
        self.full = np.ascontiguousarray(full.reshape(len(long), self.n, BLOCK).transpose(1, 0, 2))
        self.top = self.full.max(axis=2).T
        term, block = np.repeat(np.arange(terms), lens), p.example.astype(np.int64) // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.begin = np.flatnonzero(new)
        self.len = np.diff(self.begin, append=len(term))
        self.block = block[self.begin]
        self.most = np.maximum.reduceat(p.weight, self.begin) if len(term) else np.zeros(0, np.float32)
        self.starts = np.searchsorted(term[self.begin], np.arange(terms + 1))


@dataclass
class Index:
    """Examples by terms. known: hashes of terms, ascending; idf: their weights without the text's part."""

    known: np.ndarray
    rare: float  # the weight of a term that is not known
    idf: np.ndarray
    weights: Postings
    toxic: np.ndarray
    ids: np.ndarray
    none: float  # the share of toxic examples among those without a term
    slope: float = 1.0
    shift: float = 0.0
    shared: Broadcast | None = field(default=None, repr=False)
    _blocks: Blocks | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_blocks": None, "shared": None}

    @property
    def blocks(self) -> Blocks:
        if self._blocks is None:
            self._blocks = Blocks(self.weights)
        return self._blocks

    def vector(self, term: np.ndarray, often: np.ndarray) -> np.ndarray:
        w = (1 + np.log(often)) * self.idf[term]
        return (w / np.sqrt((w * w).sum())).astype(np.float32)

    def vectors(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the examples' terms in the texts; norms are over all terms of a text."""
        text, h, often = distinct_terms(own)
        at = find(self.known, h)
        w = (1 + np.log(often)) * np.where(at >= 0, self.idf[at] if len(self.idf) else 0.0, self.rare)
        w /= np.sqrt(np.bincount(text, w * w, len(own)))[text]
        return text[at >= 0], at[at >= 0], w[at >= 0].astype(np.float32)

    @staticmethod
    def best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest, best first, ties by number."""
        at = np.flatnonzero(sim >= max(np.partition(sim, -k)[-k], 1e-30)) if len(sim) > k else np.flatnonzero(sim > 0)
        order = np.lexsort((at, -sim[at]))[:k]
        return at[order], sim[at[order]]

    def search(self, text: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int, own: np.ndarray | None = None) -> np.ndarray:
        """texts x examples: similarities, exact where they may be among a text's k best. own: an example for each text, which is left out, or -1."""
        x = self.blocks
        at = x.place[term]
        long = at >= 0
        q = np.zeros((n, x.full.shape[1]), np.float32)
        q[text[long], at[long]] = w[long]
        text, term, w = text[~long], term[~long], w[~long]
        many = x.starts[term + 1] - x.starts[term]
        entry = ranges(x.starts[term], many)
        text, w, block = np.repeat(text, many), np.repeat(w, many), x.block[entry]
        # Sums of single precision are off by less than that.
        bound = (q @ x.top + np.bincount(text * x.n + block, w * x.most[entry], n * x.n).reshape(n, x.n)) * (1 + 1e-4)
        sims = np.zeros((n, x.n, BLOCK), np.float32)
        mine = None if own is None else (np.flatnonzero(own >= 0), own[own >= 0] // BLOCK, own[own >= 0] % BLOCK)

        def compare(which: np.ndarray) -> None:
            for b in np.flatnonzero(which.any(axis=0)).tolist():
                rows = np.flatnonzero(which[:, b])
                sims[rows, b] = q[rows] @ x.full[b]
            some = which[text, block]
            often = x.len[entry[some]]
            at = ranges(x.begin[entry[some]], often)
            np.add(sims, np.bincount(np.repeat(text[some] * (x.n * BLOCK), often) + self.weights.example[at], np.repeat(w[some], often) * self.weights.weight[at], sims.size).reshape(sims.shape), out=sims, casting="same_kind")
            if mine:
                sims[mine] = 0

        first = np.zeros((n, x.n), bool)
        np.put_along_axis(first, np.argpartition(bound, -min(FIRST, x.n), axis=1)[:, -min(FIRST, x.n) :], True, axis=1)
        first &= bound > 0
        compare(first)
        flat = sims.reshape(n, -1)
        least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(n, np.float32)
        compare((bound > 0) & (bound >= least[:, None]) & ~first)
        return flat

    def nearest(self, term: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.best(self.search(np.zeros(len(term), np.int64), term, w, 1, k)[0], k)

    def neighbours(self, own: list[bytes], k: int, ids: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, examples, similarities) of each text with a term. ids: of the example that each text is, which is left out."""
        text, term, w = self.vectors(own)
        place = {x: i for i, x in enumerate(self.ids.tolist())} if ids is not None else {}
        for a in range(0, len(own), TEXTS):
            b = min(a + TEXTS, len(own))
            x, y = np.searchsorted(text, [a, b])
            if x == y:
                continue
            mine = np.array([place.get(i, -1) for i in ids[a:b]]) if ids is not None else None
            sims = self.search(text[x:y] - a, term[x:y], w[x:y], b - a, k, mine)
            for i in np.unique(text[x:y]).tolist():
                yield i, *self.best(sims[i - a], k)

    def vote(self, best: np.ndarray, sim: np.ndarray) -> float:
        w = sim.astype(np.float64) ** 2
        return float(((w * self.toxic[best]).sum() + self.none) / (w.sum() + 1))

    def probability(self, vote: np.ndarray) -> np.ndarray:
        v = np.clip(vote, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-3) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through (x, y), by Newton's method with a slight pull to (1, 0)."""
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        r, q = p - y, p * (1 - p)
        g = np.array([(r * x).mean() + weight * (slope - 1), r.mean() + weight * shift])
        h = np.array([[(q * x * x).mean() + weight, (q * x).mean()], [(q * x).mean(), q.mean() + weight]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 0.0), shift


def factors(n: np.ndarray, n_toxic: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Of terms in n examples, n_toxic of them toxic, out of so many toxic and clean ones."""
    if not toxic or not clean:
        return np.full(len(n), LEAST_FACTOR)
    p, all_ = n / (toxic + clean), toxic + clean
    difference = n_toxic / toxic - (n - n_toxic) / clean
    r = difference**2 * (toxic * clean / all_**2) / np.maximum(p * (1 - p), 1e-12)
    return LEAST_FACTOR + r / (r + HALF**2)


def all_terms(examples: list[tuple]) -> np.ndarray:
    out = np.zeros(0, np.uint64)
    for i in range(0, len(examples), 256):
        out = np.unique(np.concatenate([out, *[e[2] for e in examples[i : i + 256]]]))
    return out


def alike(term: np.ndarray, w: np.ndarray, starts: np.ndarray, terms: int) -> np.ndarray:
    """An order of examples in which those that are nearest to the same one of some of them stand together. Of example i: term[starts[i]:starts[i + 1]]."""
    n = len(starts) - 1
    pivots = np.unique(np.linspace(0, n - 1, min(n, BLOCK)).astype(np.int64))
    table = np.zeros((terms, len(pivots)), np.float32)
    for j, i in enumerate(pivots.tolist()):
        table[term[starts[i] : starts[i + 1]], j] = w[starts[i] : starts[i + 1]]
    nearest = np.zeros(n, np.int64)
    for a in range(0, n, 128):
        b = min(a + 128, n)
        at = slice(starts[a], starts[b])
        nearest[a:b] = np.add.reduceat(table[term[at]] * w[at, None], starts[a:b] - starts[a]).argmax(axis=1)
    return np.argsort(nearest, kind="stable")


def build(examples: list[tuple[int, bool, np.ndarray, np.ndarray]], n: int, known: np.ndarray, df: np.ndarray) -> Index:
    """examples: (id, toxic, hashes, how often), by id; known: all their terms, ascending, which df of n documents have."""
    some, none = [e for e in examples if len(e[2])], [e[1] for e in examples if not len(e[2])]
    lens = np.array([len(e[2]) for e in some], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    term = np.searchsorted(known, np.concatenate([np.zeros(0, np.uint64), *[e[2] for e in some]])).astype(np.int32)
    often = np.concatenate([np.zeros(0, np.int32), *[e[3] for e in some]])
    toxic = np.array([e[1] for e in some], np.float64)
    of_toxic = np.repeat(toxic > 0, lens)
    factor = factors(np.bincount(term, minlength=len(known)), np.bincount(term[of_toxic], minlength=len(known)), int(toxic.sum()), len(some) - int(toxic.sum()))
    idf = (np.log((1 + n) / (1 + df)) + 1) * factor
    norm = np.zeros(len(some))
    if some:
        w = (1 + np.log(often)) * idf[term]
        norm = np.sqrt(np.add.reduceat(w * w, starts[:-1]))
        order = alike(term, (w / np.repeat(norm, lens)).astype(np.float32), starts, len(known))
    else:
        order = np.zeros(0, np.int64)
    place = np.empty(len(some), np.int16)
    place[order] = np.arange(len(some))
    # By example within a term.
    at = ranges(starts[order], lens[order])
    weights = Postings(term[at], np.repeat(place, lens)[at], often[at], idf, norm[order])
    rare = (np.log((1 + n) / (1 + n / (1 + len(examples)))) + 1) * LEAST_FACTOR
    return Index(known, rare, idf, weights, toxic[order], np.array([e[0] for e in some], np.int64)[order], (sum(none) + 0.02) / (len(none) + 1))


def held_out(id_col: str):  # noqa: ANN201
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def document_counts(rows: DataFrame, known: Broadcast) -> np.ndarray:
    """In how many rows each term is, and, at the end, how many rows there are; numbers of the size of known come to the driver."""
    kind = "part int, counts binary"

    def parts_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        terms = known.value
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, own in text_slices(batch, SLICE_BYTES):
                at = find(terms, distinct_terms(own)[1])
                total[:-1] += np.bincount(at[at >= 0], minlength=len(terms))
        yield parts_of({i: x for i, a in enumerate(range(0, len(total), PART)) if (x := total[a : a + PART]).any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(x, np.int64)
        yield parts_of(total)

    out = np.zeros(len(known.value) + 1, np.int64)
    for r in rows.mapInArrow(count, kind).repartition(16, "part").mapInArrow(add, kind).collect():
        own = np.frombuffer(r.counts, np.int64)
        out[r.part * PART : r.part * PART + len(own)] = own
    return out


def train(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """The index of at most MOST_EXAMPLES labelled rows that are not held out. Ids, labels and terms of that sample come to the driver, and the document frequencies of these terms."""
    if MOST_EXAMPLES > np.iinfo(np.int16).max:
        raise ValueError(f"examples are numbered in 16 bits, so MOST_EXAMPLES may not be {MOST_EXAMPLES}")
    spark = docs.sparkSession
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(F.col(label_col).cast("int")) == 1).alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_EXAMPLES).collect()
    label = {r.doc_id: r.toxic for r in chosen}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # Of rows with one id, one is the example.
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")
    sample = cut(rows.join(F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array([r.doc_id for r in chosen], pa.int64())}))), "doc_id").groupBy("doc_id").agg(first).select("doc_id", F.col("m.text").alias("text")))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        for batch in batches:
            got = [distinct_terms([x])[1:] for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in got], pa.binary())], ["doc_id", "terms", "often"])

    examples = sorted(((r.doc_id, label[r.doc_id], np.frombuffer(bytes(r.terms), np.uint64), np.frombuffer(bytes(r.often), np.int32)) for r in sample.mapInArrow(terms, "doc_id long, terms binary, often binary").toLocalIterator()), key=lambda e: e[0])
    known = all_terms(examples)
    shared_terms = spark.sparkContext.broadcast(known)
    counts = document_counts(rows.select("text"), shared_terms)
    shared_terms.unpersist()
    out = build(examples, int(counts[-1]), known, counts[:-1])
    shared = out.shared = spark.sparkContext.broadcast(out)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                votes = np.full(len(own), shared.value.none)
                for i, best, sim in shared.value.neighbours(own, k, some.column(0).to_pylist()):
                    votes[i] = shared.value.vote(best, sim)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(votes)], ["doc_id", "vote"])

    votes = sorted((r.doc_id, r.vote) for r in sample.mapInArrow(own_votes, "doc_id long, vote double").collect())
    if votes:
        v = np.clip(np.array([x for _, x in votes]), 1e-6, 1 - 1e-6)
        out.slope, out.shift = logistic(np.log(v / (1 - v)), np.array([label[i] for i, _ in votes], np.float64))
    return out


def _scored(docs: DataFrame, index: Index, k: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(doc_id, score, evidence) of every row, or (row, score) with the whole row as a struct."""
    shared = index.shared or docs.sparkSession.sparkContext.broadcast(index)
    fit = index.slope, index.shift  # the shared index may be from before these were known
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        index = shared.value
        index.slope, index.shift = fit
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                votes, evidence = np.full(len(own), index.none), [[] for _ in own]
                for i, best, sim in index.neighbours(own, k):
                    votes[i] = index.vote(best, sim)
                    evidence[i] = [{"doc_id": int(index.ids[j]), "similarity": float(s), "toxic": int(index.toxic[j])} for j, s in zip(best[:SHOWN], sim[:SHOWN], strict=True)]
                more = [] if whole else [pa.array(evidence, kind)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(index.probability(votes)), *more], [batch.schema.names[0], "score", *["evidence"] * len(more)])

    if whole:
        return docs.select(F.struct(*docs.columns).alias("row"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"row {docs.schema.simpleString()}, score double")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, evidence) of every row of docs; evidence: the nearest examples, at most SHOWN, with their labels.

    Edge cases: a null or empty text has no terms and gets the rate of examples without any; a very long
    one is read whole, as a slice by itself;
    repeated rows are scored each; an empty table gives an empty result; with one label only, no term leans on a label; without labels every text gets the same score; further columns are left out.
    """
    out = _scored(docs, index, k, id_col, text_col, whole=False)
    return out.select(F.col("doc_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, index: Index, threshold: float = THRESHOLD, k: int = NEIGHBOURS, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole, that score below threshold."""
    return _scored(docs, index, k, "", text_col, whole=True).where(F.col("score") < threshold).select("row.*")
