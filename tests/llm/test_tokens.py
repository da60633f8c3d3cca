"""Token counts and packing against the library itself, text by text."""

from __future__ import annotations

import binascii
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltsieve.llm.packing import pack
from siltsieve.llm.token_counts import token_counts
from siltsieve.llm.tokenizer_chunks import ByteLevelCounter, WordPieceIds, safe_pieces, word_piece_ids

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "a", " a", "a ", "a b", "a  b", "a\nb", "a\n\nb", "a\n\n\nb", "a \n b", "a\n b", "a\t b", "a\r\nb", "  \n\n ", "don't stop 'tis", "x  y", "x  y", "é  b c",
    "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|startoftext|>", "a\x00b \x00", "\x1c a \x1d\x1eb", "日本語 テキスト", "İstanbul ŠŞ", "é ́x", "12 345 a1b2", "!!! ... ,,, a.b", "\x0b\x0cx \x0b", "word " * 3000, "x" * 5000, "\n".join(["line of text"] * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, None, ODD[6]])], "doc_id long, text string"))


def test_counts_equal_the_library(spark, docs):
    tok = Tokenizer.from_file(BYTE)
    want = {r.doc_id: (len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, BYTE).collect()}
    assert got == want


def test_every_odd_pair_of_texts():
    tok, counter, words = Tokenizer.from_file(BYTE), ByteLevelCounter(BYTE), WordPieceIds(WORD)
    both = [a[:60] + b[:60] for a in ODD for b in ODD]
    assert counter.counts([x.encode() for x in both]).tolist() == [len(tok.encode(x, add_special_tokens=False)) for x in both]
    tok = Tokenizer.from_file(WORD)
    flat, n = words.ids([x.encode() for x in both])
    assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == [tok.encode(x, add_special_tokens=False).ids for x in both]


def test_memo_that_overflows_and_long_texts():
    words, tok = WordPieceIds(WORD), Tokenizer.from_file(WORD)
    words.cache.limit = 5
    for x in ODD:
        assert words.ids([x.encode()])[0].tolist() == tok.encode(x, add_special_tokens=False).ids
    tok = Tokenizer.from_file(BYTE)
    both = [a[:60] + b[:60] for a in ODD for b in ODD]
    for size in (1, 7, 40):
        assert ByteLevelCounter(BYTE, size, 100).counts([x.encode() for x in both]).tolist() == [len(tok.encode(x, add_special_tokens=False)) for x in both]
    text = ("some   words, and more\n" * 3000).encode()
    assert b"".join(safe_pieces(text, 1000)) == text
    assert ByteLevelCounter(BYTE, 1000).counts([text])[0] == len(tok.encode(text.decode(), add_special_tokens=False))


class Asked:
    """A tokenizer that notes what it is asked."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_equal_pieces_of_texts_are_encoded_once():
    counter, tok = ByteLevelCounter(BYTE), Tokenizer.from_file(BYTE)
    counter.tokenizer = Asked(counter.tokenizer)
    some = [f"some words, and more words {i % 3}\n" * 50 for i in range(20)]
    for _ in range(2):  # nothing is kept
        counter.tokenizer.texts.clear()
        assert counter.counts([x.encode() for x in some]).tolist() == [len(e) for e in tok.encode_batch_fast(some, add_special_tokens=False)]
        assert len(counter.tokenizer.texts) == len(set(counter.tokenizer.texts)) < 20
    letters = [chr(i) for i in range(0x3100) if i not in range(0xD800, 0xE000)]
    some = [f"{a} b{a} {a}\n{a}! {a}" for a in letters]
    assert counter.counts([x.encode() for x in some]).tolist() == [len(e) for e in tok.encode_batch_fast(some, add_special_tokens=False)]


def test_plain_texts_are_remembered_by_words():
    words, tok = WordPieceIds(WORD), Tokenizer.from_file(WORD)
    assert words.ids([b"ab, ab. CD, cd. ef, ef."])[0].tolist() == tok.encode("ab, ab. CD, cd. ef, ef.", add_special_tokens=False).ids
    assert words.cache.index.taken == 5  # three words, two marks
    letters = [chr(i) for i in range(0x180)]
    some = [f"{a}{b}s x{b}{a} '{a}ll" for a in letters for b in letters[::7]]
    flat, n = words.ids([x.encode() for x in some])
    assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("n_open", [1, 8])
def test_packing_round_trip(spark, docs, n_open):
    tok = Tokenizer.from_file(WORD)
    rows = pack(docs, lambda: word_piece_ids(WORD), n_open=n_open).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d in docs.collect():
        want = [*tok.encode(d.text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc.pop(d.doc_id), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array(want, "<u4").tobytes()
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)}
    assert not by_doc
    used = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        used.append(sum(r.length for r in own))
    assert max(used) <= 2048 and sum(n < 2048 for n in used) <= 1


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens string, start int")
    assert token_counts(none, BYTE).count() == 0 == pack(none, lambda: word_piece_ids(WORD)).count()
    clash = spark.createDataFrame([(1, "a b", "x", 5, 6)], "doc_id long, text string, n_tokens string, start int, part int")
    assert token_counts(clash, BYTE).collect()[0].n_tokens == 2
    assert [r.length for r in pack(clash, lambda: word_piece_ids(WORD)).collect()] == [3]


def test_query_digest(spark):
    from siltsieve.llm.queries import op2_packing

    out = op2_packing(spark, "/root/testdata/sf0.001").collect()
    again = {(r.doc_id, r.start): r for r in pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), lambda: word_piece_ids(WORD)).collect()}
    assert all(binascii.crc32(again[r.doc_id, r.start].ids) == r.ids_crc32 for r in out)
