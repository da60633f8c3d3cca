"""Byte-level BPE against the tiktoken library, text by text; the hash against its own claims."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltsieve.llm import byte_bpe, queries

from test_tokens import ODD

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.byte_bpe(PATH, PATTERN)


def want(library, text: str | None) -> tuple[int, str, str]:
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_the_query_equals_the_library(spark, library):
    rows = queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted((d.doc_id, *want(library, d.text)) for d in docs)


def test_edge_cases(spark, library):
    texts = [*ODD, None, ODD[6], "x" * 20_000, "日本語" * 3000, ("many words of a long text " * 30_000), "​  　x"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "a", b"b", "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded binary, filled string")
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(nothing, PATH, PATTERN).first().decoded is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab ", max_size=60) | st.text("aàß1 \n\t'stré", max_size=60))
def test_any_text(library, bpe, text):
    ids, n = bpe.encode([text.encode(), b"", text.encode()])
    assert ids[: n[0]].tolist() == ids[n[0] :].tolist() == library.encode_ordinary(text)
    assert bpe.decode(ids.astype(np.int64))[0] == 2 * text.encode()


def test_merge_is_the_leftmost_lowest():
    tokens = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257, b"ba": 258, b"aab": 259}
    own = byte_bpe.ByteBpe(tokens, r"(?s:.+)")
    for piece in (b"aaaaa", b"aaaa", b"aaab", b"babaab", b"baaab", b"c"):
        parts = [bytes([x]) for x in piece]
        while True:  # brute force
            ranked = [(tokens[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in tokens]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge(piece, own.first, own.pairs) == [tokens[p] for p in parts]


def test_the_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64))
        find = byte_bpe.MinimalPerfectHash(keys)
        assert sorted(find(keys).tolist()) == list(range(len(keys)))
    assert find(np.arange(100, dtype=np.uint64)).max() < 1000


def test_memo_that_overflows(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 20)
    own = byte_bpe.ByteBpe(library._mergeable_ranks, PATTERN)
    for text in ODD:
        assert own.encode([text.encode()])[0].tolist() == library.encode_ordinary(text)
    assert own.merged_bytes < 300


def test_equal_pre_tokens_are_looked_up_once(library, monkeypatch):
    own = byte_bpe.ByteBpe(library._mergeable_ranks, PATTERN)
    seen, hashes = [], own._hashes
    monkeypatch.setattr(own, "_hashes", lambda data, starts, lengths: seen.append(len(starts)) or hashes(data, starts, lengths))
    ids, n = own.encode([b"one qzxv two qzxv two", b"one qzxv two qzxv"])
    assert seen == [3]  # "one", " qzxv", " two"
    assert [p.tolist() for p in np.split(ids, n[:1])] == [library.encode_ordinary("one qzxv two qzxv two"), library.encode_ordinary("one qzxv two qzxv")]


def test_frequent_misses_stay_when_the_memo_is_full(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 400)
    own, asked, merge = byte_bpe.ByteBpe(library._mergeable_ranks, PATTERN), [], byte_bpe.merge
    monkeypatch.setattr(byte_bpe, "merge", lambda piece, *rest: asked.append(piece) or merge(piece, *rest))
    for i in range(200):
        own.encode([f"qzxvqzxv qzjk{i}qzjk".encode()])
        assert sum(map(len, [*own.merged, *own.older])) < 500
    assert asked.count(b"qzxvqzxv") == 1


def test_all_pairs_of_ascii(library, bpe):
    assert bpe.split_ascii != bpe.split
    some = [f"x{chr(a)}{chr(b)} y{chr(b)}" for a in range(128) for b in range(128)]
    ids, n = bpe.encode([x.encode() for x in some])
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [library.encode_ordinary(x) for x in some]
    assert byte_bpe.ascii_findall(r"\p{Lu}+") is None
