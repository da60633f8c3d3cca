"""Token ids by way of a bounded memo of white-space chunks.

A tokenizer that splits text into words before it merges gives every chunk between two safe
boundaries the same ids wherever it stands. Natural text repeats its words, so a worker asks the
library only for chunks it has not met, many to a call, and gathers all other ids from flat numpy
arrays. The memo is emptied when it holds `limit` chunks, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: The library gets unseen words joined to texts of so many.
WORDS_PER_TEXT = 200
#: Longer chunks are encoded but not kept.
LONGEST_KEPT = 64


class _Rows(dict):
    """chunk -> row number; an unseen chunk gets the next one and is noted in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.taken = 0

    def __missing__(self, key: str) -> int:
        self[key] = row = self.taken
        self.taken += 1
        self.new.append(key)
        return row


class ChunkCache:
    """encode: gives for a list of chunks (ids of all in one int32 array, number of ids of each, and if it likes a flag for each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, ...]], limit: int = 300_000, keep_ids: bool = True) -> None:
        self.encode, self.limit, self.keep_ids = encode, limit, keep_ids
        self.clear()

    def clear(self) -> None:
        self.index = _Rows()
        self.lens = np.zeros(1024, np.int32)
        self.flags = np.zeros(1024, bool)
        self.starts = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a) * 3 // 2) - len(a), a.dtype)])

    def rows(self, chunks: Sequence[str]) -> np.ndarray:
        """The row of each chunk; valid until the next call."""
        index = self.index
        if index.taken > self.limit:
            self.clear()
            index = self.index
        rows = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        if new := index.new:
            index.new = []
            flat, lens, *flags = self.encode(new)
            first, last = index.taken - len(new), index.taken
            self.lens = self._room(self.lens, last)
            self.lens[first:last] = lens
            if flags:
                self.flags = self._room(self.flags, last)
                self.flags[first:last] = flags[0]
            if self.keep_ids:
                self.starts = self._room(self.starts, last)
                self.starts[first:last] = self.used + np.cumsum(lens) - lens
                self.flat = self._room(self.flat, self.used + len(flat))
                self.flat[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
            for key in new:
                if len(key) > LONGEST_KEPT:
                    del index[key]
        return rows

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row)."""
        lens = self.lens[rows].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[rows] - (ends - lens), lens)
        return self.flat[at], lens


def sums(values: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    """Sums of consecutive stretches of values, `counts` long each; an empty stretch gives 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts, dtype=np.int64)
    return total[ends] - total[ends - np.asarray(counts, dtype=np.int64)]


def joined_encoder(tokenizer, shown: Callable[[str], str], plain: Callable[[str], bool], mark: np.ndarray, at_end: bool, lead: str = ""):
    """An encoder for ChunkCache on a tokenizers.Tokenizer.

    shown: a chunk as the library is to see it. plain: whether joined chunks can be told apart
    again by marked ids, one to a chunk (the last one of each if at_end, else the first). Where the
    number of marked ids is not that of the chunks, these are encoded one by one.
    """

    def one_by_one(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = [shown(x) for x in chunks]
        ids: list[np.ndarray | None] = [None] * len(texts)
        easy = [i for i, t in enumerate(texts) if plain(t)]
        hard = [i for i, t in enumerate(texts) if not plain(t)]
        groups = [easy[i : i + WORDS_PER_TEXT] for i in range(0, len(easy), WORDS_PER_TEXT)]
        for group, got in zip(groups, one_by_one([lead.join(texts[i] for i in g) for g in groups]), strict=True):
            at = np.flatnonzero(mark[got])
            if len(at) != len(group) or not at_end and at[0]:
                hard += group
                continue
            cuts = at[:-1] + 1 if at_end else at[1:]
            for i, part in zip(group, np.split(got, cuts), strict=True):
                ids[i] = part
        for i, part in zip(hard, one_by_one([texts[i] for i in hard]), strict=True):
            ids[i] = part
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), lens

    return encode
