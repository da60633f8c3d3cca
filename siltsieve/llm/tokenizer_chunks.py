"""The two tokenizers whose boundaries the operators rely on: to cut long texts, and to remember chunks (ChunkCache)."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict

import numpy as np

from ._shared import byte_slices, memo
from .chunk_cache import WORDS_PER_TEXT, ChunkCache, joined_encoder, sums

#: A safe place to cut a text: before a space or line end that follows a visible ASCII character.
SAFE = re.compile(rb"(?<=[!-~])(?=[ \n])")
#: How a tokenizer with word ends cuts small letters; PLAIN_WORDS does the same in PLAIN texts.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN, PLAIN_WORDS = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*"), re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def bare_bpe(path: str):
    """A tokenizer that cuts by WORD_PATTERN, without its normalizer, for words between single spaces; None for another tokenizer."""
    with open(path) as f:
        made = json.load(f)
    steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
    cuts = [(s["pattern"], s["behavior"], s["invert"]) for s in steps if s["type"] == "Split"]
    bytes_only = [s["add_prefix_space"] or s["use_regex"] for s in steps if s["type"] == "ByteLevel"]
    if len(steps) != 2 or cuts != [({"Regex": WORD_PATTERN}, "Removed", True)] or bytes_only != [False]:
        return None
    from tokenizers import normalizers, pre_tokenizers

    out = load(path)
    out.normalizer, out.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def safe_pieces(text: bytes, limit: int) -> list[bytes]:
    """text in pieces of about limit bytes, cut at safe places only; a stretch without one stays whole."""
    if len(text) <= limit:
        return [text]
    out, a = [], 0
    while len(text) - a > limit:
        if not (m := SAFE.search(text, a + limit)):
            break
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


class ByteLevelCounter:
    """Numbers of tokens of a byte-level BPE whose pattern lets a token hold a space only at its start.

    A boundary from a visible character to white space is then always a boundary of tokens, so texts
    are cut there. Equal pieces of the texts of one call have equal numbers: each different one is
    encoded once, in batches of about equal bytes; nothing is kept from call to call.
    """

    def __init__(self, path: str, piece_bytes: int = 1 << 18, batch_bytes: int = 1 << 18) -> None:
        self.tokenizer, self.piece_bytes, self.batch_bytes = load(path), piece_bytes, batch_bytes

    def counts(self, texts: list[bytes]) -> np.ndarray:
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        parts = [(i, p) for i, text in enumerate(texts) for p in safe_pieces(text, self.piece_bytes)]
        found = [np.fromiter(map(place.__getitem__, SAFE.split(p)), np.int32) for _, p in parts]
        pieces = list(place)
        n = np.zeros(len(pieces), np.int64)
        for a, b in byte_slices([len(p) for p in pieces], self.batch_bytes):
            n[a:b] = [len(e) for e in self.tokenizer.encode_batch_fast([p.decode(errors="replace") for p in pieces[a:b]], add_special_tokens=False)]
        out = np.zeros(len(texts), np.int64)
        np.add.at(out, [i for i, _ in parts], [n[x].sum() for x in found])
        return out


def plain_words(text: str) -> list[str]:
    """What WORD_PATTERN finds in a PLAIN text once its letters are small."""
    return PLAIN_WORDS.findall(text.lower())


class WordPieceIds:
    """Ids of a BPE with word ends that drops white space: every white-space chunk is encoded by itself.

    Most texts are ASCII and whole letters of Latin-1. Nothing is to be normalized there but the case
    of letters, so these are cut here into the library's words, of which there are fewer different
    ones; unseen words go to its BPE without its normalizer and pattern, which take most of its time.
    All else passes through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        self.mark[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.whole = joined_encoder(self.tokenizer, str, str.isalpha, self.mark, at_end=True, lead=" ")
        self.bare = bare_bpe(path)
        self.cache = ChunkCache(self.encode if self.bare else self.whole)

    def cut(self, text: bytes) -> list[str]:
        """The words of a plain text, the chunks of others."""
        shown = text.decode(errors="replace")
        if self.bare and PLAIN.fullmatch(shown) and "<|" not in shown:
            return plain_words(shown)
        chunks = (text if b"<|" in text else text.lower()).split()  # ASCII letters lose case anyway, but for special strings
        return b" ".join(chunks).decode(errors="replace").split(" ") if chunks else []

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [i for i, x in enumerate(chunks) if PLAIN.fullmatch(x) and "<|" not in x]
        got = self.plain([chunks[i] for i in plain])
        if got is None:
            return self.whole(chunks)
        rest = np.delete(np.arange(len(chunks)), plain).tolist()
        other = self.whole([chunks[i] for i in rest])
        lens = np.zeros(len(chunks), np.int32)
        lens[plain], lens[rest] = got[1], other[1]
        starts = np.cumsum(lens) - lens
        out = np.zeros(int(lens.sum()), np.int32)
        for which, (flat, n) in ((plain, got), (rest, other)):
            out[np.arange(len(flat)) + np.repeat(starts[which] - (np.cumsum(n) - n), n)] = flat
        return out, lens

    def plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As encode, for PLAIN chunks; None where words can't be told apart by their ends."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        own = [plain_words(x) for x in chunks]
        words, last = [w for x in own for w in x], np.cumsum([len(x) for x in own])
        texts = [" ".join(words[i : i + WORDS_PER_TEXT]) for i in range(0, len(words), WORDS_PER_TEXT)]
        flat = np.concatenate([np.array(e.ids, np.int32) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.mark[flat]) + 1
        if len(ends) != len(words):
            return None
        return flat, np.diff(ends[last - 1], prepend=0).astype(np.int32)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        own = [self.cut(t) for t in texts]
        counts = [len(x) for x in own]
        flat, lens = self.cache.ids(self.cache.rows([w for x in own for w in x]))
        return flat, sums(lens, counts)


@memo
def byte_level_counter(path: str) -> ByteLevelCounter:
    """One to a worker, kept from task to task."""
    return ByteLevelCounter(path)


@memo
def word_piece_ids(path: str) -> WordPieceIds:
    return WordPieceIds(path)
