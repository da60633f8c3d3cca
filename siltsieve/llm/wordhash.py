"""Words, word n-grams and their 64-bit hashes for batches of texts, in numpy.

A word is a run of bytes other than ASCII white space. Its hash is a polynomial over a table of
random numbers, one for each byte, modulo 2**64; n-grams combine the hashes of their words. The
numbers come from a fixed seed, so that all executors and runs agree. Two different words or
n-grams get the same hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

from .chunk_cache import sums

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20_240_117))
TABLE = _random.integers(0, 1 << 64, 256, np.uint64)
TABLE[SPACE] = 0
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]
BASE = np.uint64(int(_random.integers(0, 1 << 63)) * 2 + 1)
PLACES = _random.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0, 1, ..., n - 1."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch: hashes of all, counts by text, and the batch's bytes with a space after each text.

    between: for each byte, whether it stands between words. prefixes: also hash words' first so many bytes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> None:
        self.data = data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)  # of each text with its space
        space = between[data]
        first = ~space
        first[1:] &= space[:-1]
        self.starts = np.flatnonzero(first)
        self.counts = np.diff(np.searchsorted(self.starts, self.ends), prepend=0)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            self.prefixes = [self.hashes] * len(prefixes)
            return
        begin = self.starts[0]
        spans = np.diff(self.starts, append=len(data))
        place = np.arange(begin, len(data)) - np.repeat(self.starts, spans)
        place[space[begin:]] = 0
        values = (LOWER if lower else TABLE)[data[begin:]] * powers(int(place.max()) + 1)[place]
        if between is not SPACE:
            values[space[begin:]] = 0
        self.hashes = mix(np.add.reduceat(values, self.starts - begin))
        self.prefixes = [mix(np.add.reduceat(np.where(place < n, values, np.uint64(0)), self.starts - begin) + np.uint64(n)) for n in prefixes]

    def sums_of(self, flags: np.ndarray) -> np.ndarray:
        """For each text, the sum of a table of 256 values over its bytes."""
        return sums(flags[self.data], np.diff(self.ends, prepend=0))


def ngrams(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of k words within a text, number of runs of each text)."""
    n = np.maximum(counts - k + 1, 0)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), n
    out = hashes[: len(hashes) - k + 1] * PLACES[0]
    for j in range(1, k):
        out += hashes[j : len(hashes) - k + 1 + j] * PLACES[j]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(out)] - np.arange(len(out))  # words of the text from here on
    return mix(out[left >= k] + np.uint64(k)), n


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ngrams, but a text of fewer than k words (one at least) has its whole sequence as the only one."""
    out, n = ngrams(hashes, counts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return out, n
    begins = np.cumsum(counts) - counts
    own = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        own[has] += hashes[begins[short[has]] + j] * PLACES[j]
    own = mix(own + counts[short].astype(np.uint64))
    at = (np.cumsum(n) - n)[short]
    n[short] = 1
    return np.insert(out, at, own), n


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values in ascending order, once each."""
    out, n, at = [], np.zeros(len(counts), np.int64), 0
    for i, k in enumerate(counts.tolist()):
        if k:
            own = np.sort(values[at : at + k])
            if k > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            out.append(own)
            n[i] = len(own)
            at += k
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), n
