"""Byte-level BPE encoding and decoding from a file of ranks, in two tiers.

A text is cut into pre-tokens by the pattern. All different ones of a slice of texts are hashed at once and
looked up through a minimal perfect hash of the vocabulary: what stands at the slot is compared byte by
byte, and equal bytes are one token. The others are merged in the second tier: bytes as a linked list, a
heap of neighbouring pairs by (rank, place), stale pairs left out as they come up. Results of merges
are remembered up to a number of bytes, the older half leaving, since misspelt and rare words come again.

Decoding is a gather of the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, memo, text_or_empty, text_slices
from .chunk_cache import sums
from .tokenizer_chunks import safe_pieces
from .wordhash import mix, powers

SLICE_BYTES = 1 << 20
#: Longer texts are cut at safe places; of white space, the pattern lets a token hold only what comes first in it.
PIECE_BYTES = 1 << 18
#: Bytes of merged pre-tokens that a worker remembers; a longer one than the second number is not remembered.
MEMO_BYTES, MEMO_LONGEST = 4 << 20, 256


class MinimalPerfectHash:
    """Distinct 64-bit keys -> 0, 1, ..., n - 1, without keeping the keys.

    A level deals its keys to twice as many places; keys that are alone at theirs stay there, the
    others go on to the next level. A key's number is how many places are taken before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        before = 0
        while len(keys):
            at = self._places(keys, len(self.levels), 2 * len(keys) + 1)
            taken = np.bincount(at, minlength=2 * len(keys) + 1) == 1
            self.levels.append((taken, before + np.cumsum(taken, dtype=np.int64) - taken))
            before += int(taken.sum())
            keys = keys[~taken[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for one that was not there when this was built, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, number) in enumerate(self.levels):
            at = self._places(keys[left], level, len(taken))
            here = taken[at]
            out[left[here]] = number[at[here]]
            left = left[~here]
            if not len(left):
                break
        return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of [start, start + length), one span after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def merge(piece: bytes, first: list[int], pairs: dict[int, int], couples: list[list[int]] | None = None) -> list[int]:
    """Tokens of a pre-token: the neighbours of the lowest rank are merged first, the leftmost of equal ones.

    first: the id of each byte. pairs: left id << 32 | right id -> the rank of both together. couples:
    the rank of any two bytes together, or -1.
    """
    n = len(piece)
    ids = [first[x] for x in piece]
    get = pairs.get
    at = [couples[x][y] for x, y in zip(piece, piece[1:])] if couples else [get(x << 32 | y, -1) for x, y in zip(ids, ids[1:])]  # rank of the pair that begins here
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [r << bits | i for i, r in enumerate(at) if r >= 0]
    at.append(-1)
    follows, before = [*range(1, n + 1)], [*range(-1, n)]  # starts of the parts after and before
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        x = pop(heap)
        r, a = x >> bits, x & low
        if at[a] != r:  # stale
            continue
        b = follows[a]
        c = follows[b]
        ids[a], follows[a], before[c], at[b], ids[b] = r, c, a, -1, -1
        at[a] = x = get(r << 32 | ids[c], -1) if c < n else -1
        if x >= 0:
            push(heap, x << bits | a)
        if a:
            p = before[a]
            at[p] = x = get(ids[p] << 32 | r, -1)
            if x >= 0:
                push(heap, x << bits | p)
    return [i for i in ids if i >= 0]


def ascii_findall(pattern: str) -> Callable[[str], list[str]] | None:
    """What a pattern finds in texts of ASCII alone, by Python's own re, which is faster; None where that has no such pattern."""
    classes = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}
    for name, own in classes.items():
        pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, own), pattern).replace(name, f"[{own}]")  # noqa: B023
    try:
        return re.compile(pattern, re.ASCII).findall
    except re.error:
        return None


class ByteBpe:
    """tokens: bytes -> rank, the rank being the id. All single bytes must be among them."""

    def __init__(self, tokens: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split = tokens, regex.compile(pattern).findall
        self.split_ascii = ascii_findall(pattern) or self.split
        self.first = [tokens[bytes([i])] for i in range(256)]
        halves = ((tokens.get(t[:i]), tokens.get(t[i:]), r) for t, r in tokens.items() for i in range(1, len(t)))
        self.pairs = {x << 32 | y: r for x, y, r in halves if x is not None and y is not None}
        self.couples = [[self.pairs.get(x << 32 | y, -1) for y in self.first] for x in self.first]
        own = sorted(tokens, key=tokens.get)
        self.lengths = np.zeros(max(tokens.values()) + 1, np.int64)  # by id
        ids = np.array([tokens[t] for t in own])
        self.lengths[ids] = [len(t) for t in own]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(own), np.uint8)
        seed = 0
        while True:  # until no two tokens have the same hash
            self.table = np.random.Generator(np.random.PCG64(1_120_031 + seed)).integers(0, 1 << 64, 256, np.uint64)
            keys = self._hashes(self.data, self.starts[ids], self.lengths[ids])
            if len(np.unique(keys)) == len(keys):
                break
            seed += 1
        self.find = MinimalPerfectHash(keys)
        self.id_at = np.zeros(len(keys), np.int64)
        self.id_at[self.find(keys)] = ids
        self.key_of = np.zeros(len(self.lengths), np.uint64)
        self.key_of[ids] = keys
        self.merged: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.merged_bytes = 0

    def _hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of consecutive spans that cover data."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        return mix(np.add.reduceat(self.table[data] * powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64))

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, four bytes to an id. Of what is remembered, the half that was not asked for of late goes when it is full."""
        out = []
        for piece in pieces:
            got = self.merged.get(piece)
            if got is None:
                got = self.older.get(piece) or array("I", merge(piece, self.first, self.pairs, self.couples)).tobytes()
                if len(piece) <= MEMO_LONGEST:
                    if self.merged_bytes > MEMO_BYTES // 2:
                        self.older, self.merged, self.merged_bytes = self.merged, {}, 0
                    self.merged[piece] = got
                    self.merged_bytes += len(piece)
            out.append(got)
        return out

    def _encode_pieces(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: defaultdict[str, int] = defaultdict()  # equal pre-tokens are looked up once
        number.default_factory = number.__len__
        found = []
        for t in own:
            cut = (self.split_ascii if t.isascii() else self.split)(t.decode(errors="replace"))
            found.append(np.fromiter(map(number.__getitem__, cut), np.int64, len(cut)))
        counts = np.array([len(x) for x in found], np.int64)
        which = np.concatenate([np.zeros(0, np.int64), *found])
        words = list(number)
        del found, number
        data = np.frombuffer("".join(words).encode(), np.uint8)
        chars = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
        ends = np.append(chars, len(data))[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        lengths = np.diff(ends, prepend=0)
        starts = ends - lengths
        keys = self._hashes(data, starts, lengths)
        at = self.find(keys)
        ids = self.id_at[at]
        known = np.flatnonzero((at >= 0) & (self.key_of[ids] == keys) & (self.lengths[ids] == lengths))
        if len(known):
            n = lengths[known]
            differs = data[spans(starts[known], n)] != self.data[spans(self.starts[ids[known]], n)]
            known = known[~np.logical_or.reduceat(differs, np.cumsum(n) - n)]
        whole = np.zeros(len(ids), bool)
        whole[known] = True
        missed = np.flatnonzero(~whole)
        raw = data.tobytes()
        parts = self._merge([raw[a:b] for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)])
        n = np.ones(len(ids), np.int64)
        n[missed] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        places = np.cumsum(n) - n
        flat = np.empty(int(n.sum()), np.uint32)
        flat[places[known]] = ids[known]
        flat[spans(places[missed], n[missed])] = np.frombuffer(b"".join(parts), np.uint32)
        n, places = n[which], places[which]
        return flat[spans(places, n)], sums(n, counts)

    def encode(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        pieces = [safe_pieces(t, PIECE_BYTES) for t in own]
        out, n = self._encode_pieces([p for x in pieces for p in x])
        return out, sums(n, np.array([len(x) for x in pieces], np.int64))

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids one after another, number of bytes of each)."""
        n = self.lengths[ids]
        return self.data[spans(self.starts[ids], n)].tobytes(), n


@memo
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One to a worker, kept from task to task. path: lines of a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row of docs; ids: binary, unsigned 32-bit integers, the least significant byte first.

    Special tokens in a text are ordinary text. Edge cases: a null text counts as empty, an empty one has
    no ids; repeated rows are encoded each; a null id stays null; an empty table gives an empty result;
    further columns, whatever their names, are left out. A very long text is cut where the pattern always
    cuts, and worked on slice by slice; a single pre-token needs about 200 times its bytes of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                ids, n = bpe.encode(own)
                ends = 4 * np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([raw[a:b] for a, b in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)], pa.binary())], ["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary").withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded) of every row of encode's result; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES, "filled"):
                ids = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
                raw, n = bpe.decode(ids)
                size = sums(n, np.array([len(x) // 4 for x in own], np.int64))
                ends = np.cumsum(size)
                got = [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(got, pa.binary(), mask=np.array(some.column(1).is_null()))], ["doc_id", "ids", "decoded"])

    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"), F.coalesce(ids_col, F.lit(b"")).alias("filled"))
    return own.mapInArrow(run, "doc_id long, ids binary, decoded binary").withColumnsRenamed({"doc_id": id_col, "ids": ids_col})
