"""Quality rules for documents, judged again by host.

Each document gets a few counts and fails or passes each rule. Failures are summed by host (one
partial sum a task, so a host with a third of all rows is no burden). A host's failure rates are
shrunk towards all hosts' by a beta prior that is fitted to the hosts themselves, so a host with
few documents is judged mildly; a host whose shrunk rate passes a limit for any rule is rejected,
and its verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, evict, text_or_empty, text_slices
from .wordhash import SPACE, Words, ngrams, sums

SLICE_BYTES = 1 << 20
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: A host is rejected if the shrunk failure rate of any rule is above this.
LIMIT = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_CHAR = ~SPACE
_CHAR[0x80:0xC0] = False  # later bytes of a code point
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeat_words(hashes: np.ndarray, counts: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text, how many words lie in runs of k words that it holds twice or more."""
    runs, n = ngrams(hashes, counts, k)
    covered = np.zeros(len(hashes), bool)
    if len(runs):
        text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        key = runs ^ (text * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(runs), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        at = at + np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)[at]  # place of the run's first word
        for j in range(k):
            covered[at + j] = True
    return sums(covered, counts)


def count_batch(own: list[bytes]) -> list[np.ndarray]:
    w = Words(own)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in own]
    dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return [w.counts.astype(np.int64), w.sums_of(_CHAR), w.sums_of(_SYMBOL), dup, repeat_words(w.hashes, w.counts)]


def document_counts(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", host_col: str = "source", whole: bool = False) -> DataFrame:
    """(doc_id, host and COUNTS) of every row, or with the whole row as a struct `row` for doc_id; a null text counts as one without words. id_col: None for no ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evict()
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), *map(pa.array, count_batch(own))], [batch.schema.names[0], "host", *COUNTS])

    first = F.struct(*docs.columns).alias("row") if whole else (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id")
    rows = docs.select(first, text_or_empty(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    return rows.mapInArrow(count, f"{f'row {docs.schema.simpleString()}' if whole else 'doc_id long'}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, Column]:
    """Rule -> whether a document fails it. `base` alone rejects a document; all are summed by host."""
    n = F.col("n_words")
    return {
        "base": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def beta_prior(rates: DataFrame, fails: str) -> tuple[float, float]:
    """(alpha, beta) of the hosts' failure rates by the method of moments; rates has a row for each host with n and fails.

    The spread that chance alone gives to a rate of n documents is taken off. One row comes to the driver.
    """
    p, n = F.col(fails) / F.col("n"), F.col("n")
    row = rates.agg(F.avg(p).alias("m"), F.var_samp(p).alias("v"), F.avg(1 / n).alias("inv"), F.count("*").alias("hosts")).first()
    if not row.hosts:
        return 1.0, 1.0
    m = min(max(row.m, 1e-4), 1 - 1e-4)
    noise = m * (1 - m) * row.inv
    spread = max((row.v or 0.0) - noise, m * (1 - m) * 1e-3)
    strength = min(max(m * (1 - m) / spread - 1, 2.0), 1000.0)
    return m * strength, (1 - m) * strength


def host_verdicts(counts: DataFrame, limit: float) -> DataFrame:
    """(host, host_rate, host_rejected): the highest shrunk failure rate of each host, and whether it is above limit. counts: host and fail_<rule>."""
    hosts = cut(counts.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(r) for r in rules()]))
    shrunk = []
    for r in rules():
        alpha, beta = beta_prior(hosts, r)
        shrunk.append((F.col(r) + alpha) / (F.col("n") + alpha + beta))
    return hosts.select("host", F.greatest(*shrunk).alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > limit)


def _failures(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"fail_{r}": c for r, c in rules().items()})


def quality_rules(docs: DataFrame, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each of docs: id, host, COUNTS, base_failed, fail_<rule>, host_rate (the highest shrunk rate), host_rejected, kept.

    limit: a host is rejected if the shrunk rate of any rule is above it.

    Edge cases: a null text has no words and fails `base`; a null host is no host, its documents are
    judged by themselves; repeated rows count each; a very long text is counted whole, as a slice by
    itself; an empty table gives an empty result; further columns are left out.
    """
    counts = cut(_failures(document_counts(docs, id_col, text_col, host_col)))
    out = counts.join(host_verdicts(counts, limit), "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select(F.col("doc_id").alias(id_col), F.col("host").alias(host_col), *COUNTS, F.col("fail_base").alias("base_failed"), *[f"fail_{r}" for r in rules()], "host_rate", "host_rejected", (~F.col("fail_base") & ~F.col("host_rejected")).alias("kept"))


def keep_good(docs: DataFrame, limit: float = LIMIT, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs, whole, that quality_rules keeps. Texts are counted twice instead of being shuffled."""
    counted = _failures(document_counts(docs, text_col=text_col, host_col=host_col, whole=True))
    verdicts = host_verdicts(_failures(document_counts(docs, None, text_col, host_col)), limit).where("host_rejected").select("host")
    return counted.where(~F.col("fail_base")).join(verdicts, "host", "left_anti").select("row.*")
