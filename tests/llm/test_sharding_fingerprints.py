from __future__ import annotations

import binascii
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siltsieve.llm import ngram_jaccard
from siltsieve.llm.fingerprints import fingerprints, fingerprints_and_classes, minhash_texts, near_copies
from siltsieve.llm.ngram_jaccard import star_pairs
from siltsieve.llm.queries import op9_fingerprints
from siltsieve.llm.sharding import least_loaded, shard
from test_ngram_jaccard import brute

ODD = [None, "", " ", "a", "é", "a b c", "日本" * 2000, "same text here " * 30, "same text here " * 30, "x"]


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_shards(spark):
    docs = documents(spark)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = shard(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(text))
    loads, slots, of = Counter(), defaultdict(list), {}
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, binascii.crc32(data), "bytes", None)
        assert of.setdefault(text[r.doc_id], r.shard) == r.shard
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(loads) <= set(range(24))
    groups = Counter()
    for t in text.values():
        groups[t] += len(t.encode()) + 8
    assert max(loads.values()) <= max(4 / 3 * sum(loads.values()) / 24, max(groups.values())) * 1.05


def plain_schedule(sizes: list[int], n: int) -> list[int]:
    """Loads after each group, the largest first, went to the shard with the least."""
    loads = [0] * n
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return loads


def test_schedule_is_that_of_all_groups(spark):
    assert least_loaded([(5, 1), (4, 1), (3, 2)], 2) == [(5, [1, 0]), (4, [0, 1]), (3, [1, 1])]
    r = random.Random(4)
    for _ in range(200):
        n = r.choice([1, 2, 5, 24])
        sizes = {r.randint(1, r.choice([3, 60, 2000])): r.choice([1, 2, 30, 400]) for _ in range(r.choice([1, 4, 40]))}
        got = least_loaded(list(sizes.items()), n)
        assert {s: sum(c) for s, c in got} == sizes
        assert [sum(s * c[i] for s, c in got) for i in range(n)] == plain_schedule([s for s, k in sizes.items() for _ in range(k)], n)
    for docs in (documents(spark), spark.range(60_000).selectExpr("id as doc_id", "concat('t', id) as text")):
        rows = shard(docs).collect()
        groups, loads = Counter(), Counter()
        for x in docs.collect():
            groups[x.text or ""] += len((x.text or "").encode()) + 8
        for x in rows:
            loads[x.shard] += x["size"]
        assert [loads[i] for i in range(24)] == plain_schedule(list(groups.values()), 24)


def test_fingerprints(spark):
    docs = documents(spark)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    ids = sorted(text, reverse=True)
    assert sorted(rows) == sorted(text)
    for i, d in enumerate(ids):
        s, nxt, r = text[d], text[ids[(i + 1) % len(ids)]], rows[d]
        half = len(s) // 2
        want = s[: len(s) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(s), hashlib.sha256(want.encode()).hexdigest())
        a, b, c = minhash_texts([s.encode(), want.encode(), nxt.encode()])
        assert r.fingerprint == a.astype(">u2").tobytes().hex() and r.edited_fingerprint == b.astype(">u2").tobytes().hex()
        assert abs(r.near_edited - np.mean(a == b)) < 1e-9 and abs(r.near_next - np.mean(a == c)) < 1e-9


def test_likeness_estimates_jaccard():
    words = [f"w{i}" for i in range(1000)]
    a, b = minhash_texts([" ".join(words).encode(), " ".join(words[:900]).encode()])
    assert abs(np.mean(a == b) - 0.9) < 0.08


def test_empty_ties_and_clashes(spark):
    none = spark.createDataFrame([], "doc_id long, text string, size int, bucket int")
    assert shard(none).count() == 0 == fingerprints(none).count()
    one = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, size int, bucket int, shard int")
    assert shard(one).count() == 1 and fingerprints(one).first().near_next == 1.0
    tied = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c")], "doc_id long, text string")
    assert shard(tied).count() == 4 == fingerprints(tied).count()


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_copies(docs).collect()}
    assert got == {d: c for d, (_, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items()}
    assert near_copies(spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "doc_id long, text string")).where("class_id <> doc_id").count() == 0


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(w if j != k else f"x{k}" for j, w in enumerate(words)) for k in range(200)]
    texts += [" ".join(r.choices("abcdefgh", k=40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []

    def counted(lists, *args, **named):
        pairs = star_pairs(lists, *args, **named)
        seen.append((lists.count(), pairs.agg(F.sum("c")).first()[0] or 0))
        return pairs

    monkeypatch.setattr(ngram_jaccard, "star_pairs", counted)
    got = {r.doc_id: r.class_id for r in near_copies(docs).collect()}
    assert got == {d: c for d, (_, c) in brute(list(enumerate(texts))).items()}
    assert len(seen) >= 2 and all(pairs <= 3 * rows for rows, pairs in seen)


def test_query_gives_classes_of_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op9_fingerprints(spark, "/root/testdata/sf0.01").collect()
    want = {d: c for d, (_, c) in brute([(r.doc_id, r.text) for r in docs.collect()]).items()}
    assert len(rows) == len(want) and {r.doc_id: r.class_id for r in rows} == want
    assert any(d != c for d, c in want.items())
    t = " ".join(f"w{i}" for i in range(60))
    odd = spark.createDataFrame([(5, t), (5, "other words"), (7, t + " end"), (7, t + " end"), (None, t), (8, None), (None, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_chars, r.class_id) for r in fingerprints_and_classes(odd).collect())
    assert got == sorted([(5, len(t), 5), (5, 11, 5), (7, len(t) + 4, 5), (7, len(t) + 4, 5), (0, len(t), 5), (8, 0, 8), (0, 0, None)], key=lambda x: x[:2])


def test_fingerprints_in_plain_python(spark):
    from siltsieve.llm import wordhash
    from siltsieve.llm.fingerprints import A, B, fingerprints

    whole = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & whole
        return x ^ (x >> 31)

    def word(w):
        return mix(sum(int(wordhash.TABLE[b + 32 if 65 <= b <= 90 else b]) * pow(int(wordhash.BASE), i, 1 << 64) for i, b in enumerate(w)) & whole)

    def run(words):
        return mix((sum(h * int(p) for h, p in zip(words, wordhash.PLACES)) + len(words)) & whole)

    def printed(text):
        words = [word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
        grams = [run(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        least = [min(((x * int(a) + int(b)) & whole) >> 32 for x in grams) & 0xFFFF if grams else 0xFFFF for a, b in zip(A[:128], B[:128])]
        return "".join(f"{x:04x}" for x in least)

    texts = ["", "one", "One two\tthree", "a b c d e", "The same words and the SAME words and the same words, é日本 again", " ".join(f"w{i % 17}" for i in range(80))]
    rows = {r.doc_id: r for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert rows[i].fingerprint == printed(text)
        following = texts[i - 1]  # descending ids; after the last the first
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[i].edited_fingerprint == printed(edited)
        a, b = printed(text), printed(edited)
        assert rows[i].near_edited == sum(a[j : j + 4] == b[j : j + 4] for j in range(0, 512, 4)) / 128
