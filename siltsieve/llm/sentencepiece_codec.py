"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protocol buffer wire format), and a tokenizers.Tokenizer is rebuilt
from it: normaliser, metaspace marker, unigram scores or BPE merges, byte fallback. It encodes
batches of texts in the library's threads.

Verified parity: sentencepiece encodes every text, too. Where a text's ids differ (the library breaks
ties between merges of equal score in another order) those of sentencepiece stand, and the text is
marked as unequal.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import memo, text_or_empty, text_slices
from .chunk_cache import sums

MARK = "▁"
SLICE_BYTES = 1 << 20
#: Threads of the libraries for a task of one core: batches end in single texts, while others wait.
THREADS = 2
#: Kinds of pieces and models, as the model format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; nested messages stay bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            shift += 7
            i += 1
            if data[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in wire_fields(data):
            if number == 1:
                own = dict(wire_fields(value))
                m.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(wire_fields(value))
                m.kind, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(wire_fields(value))
                m.charsmap = own.get(2, b"")
                m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if m.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be rebuilt")
        return m

    def merges(self) -> list[tuple[str, str]]:
        """Every way to put a piece together from two others, best score first."""
        known = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
        found = [(-score, i, k) for i, (p, score, kind) in enumerate(self.pieces) if p in known for k in range(1, len(p)) if p[:k] in known and p[k:] in known]
        return [(self.pieces[i][0][:k], self.pieces[i][0][k:]) for _, i, k in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind == UNIGRAM:
            out = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback))
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            out = Tokenizer(models.BPE(vocab=vocab, merges=self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if self.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        strip = [decoders.Strip(" ", 1, 0)] if self.add_dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out


class Codec:
    def __init__(self, path: str, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        self.judge = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.whole = self.model.tokenizer()
        table = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.piece_lens = np.array([len(x) for x in table], np.int64)
        self.piece_starts = np.cumsum(self.piece_lens) - self.piece_lens
        self.piece_bytes = np.frombuffer(b"".join(table), np.uint8)

    def ids(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each, 1 for each to which the rebuilt tokenizer gave other ids)."""
        shown = [x.decode(errors="replace") for x in own]
        got = [e.ids if x else [] for x, e in zip(own, self.whole.encode_batch_fast(shown, add_special_tokens=False), strict=True)]
        want = self.judge.encode(shown, num_threads=self.threads)
        unequal = np.array([g != w for g, w in zip(got, want, strict=True)], np.int64)
        for i in np.flatnonzero(unequal).tolist():
            got[i] = want[i]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum())), counts, unequal

    def texts(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The inverse of ids(): the bytes that the pieces stand for, gathered from a table."""
        lens = self.piece_lens[flat]
        ends = np.cumsum(lens)
        data = self.piece_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.piece_starts[flat] - (ends - lens), lens)].tobytes()
        out, at = [], 0
        for n in sums(lens, counts).tolist():
            own = data[at : at + n]
            out.append(own[1:] if self.model.add_dummy_prefix and own[:1] == b" " else own)
            at += n
        return out


@memo
def codec(path: str, threads: int = THREADS) -> Codec:
    """One to a worker, kept from task to task."""
    return Codec(path, threads)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string, unequal long) of every row of docs.

    decoded: the text that the ids stand for. ids: of the rebuilt tokenizer; where those of
    sentencepiece are others, unequal is 1 and they stand.

    Edge cases: a null text counts as empty and has no ids; an empty table gives an empty result;
    repeated rows are encoded each; further columns, also any named like the results, are left out. A
    very long text is encoded whole, in a batch of its own.
    """
    cores = threads or max(THREADS, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, cores)
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                flat, counts, unequal = c.ids(own)
                back = c.texts(flat, counts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(back, pa.binary()).cast(pa.string()), pa.array(unequal)], ["doc_id", "ids", "decoded", "unequal"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string, unequal long").withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text that array<int> ids_col stands for in a column `into`; null ids give null."""

    @F.pandas_udf("string")
    def run(ids):  # noqa: ANN001, ANN202
        c, known = codec(model_path), ids.notna()
        out = ids.astype(object).where(~known, None)
        own = [np.asarray(x, np.int64) for x in ids[known]]
        if own:
            out[known] = [x.decode(errors="replace") for x in c.texts(np.concatenate(own), np.array([len(x) for x in own]))]
        return out

    return rows.withColumn(into, run(F.col(ids_col)))
