from __future__ import annotations

import random
import re

import pytest

from siltsieve.llm import ngram_jaccard as module
from siltsieve.llm.ngram_jaccard import keep_one, ngram_jaccard
from siltsieve.operators.graph import components


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    by: dict[tuple, list[int]] = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed: int) -> list[tuple[int, str | None]]:
    """Chains of edited copies of many sizes, around the threshold, with common passages and groups of copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage, out = [word() for _ in range(40)], []
    for g in range(60):
        words = [word() for _ in range(r.choice([3, 5, 8, 20, 60, 200]))]
        if r.random() < 0.5:
            words = words[: len(words) // 2] + passage + words[len(words) // 2 :]
        for _ in range(r.choice([1, 2, 5, 40 if g % 20 == 0 else 3])):
            words = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, len(words) // 50 + 1])):
                words[r.randrange(len(words))] = word()
            out.append(" ".join(words).upper() if r.random() < 0.1 else " ".join(words))
    out += ["", None, " ", "one", "ONE", "a b c d", "a b c d", "a b c D e"]
    ids = r.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed > 1:
        monkeypatch.setattr(module, "LEAST_FREQUENT", 1)
    if seed > 2:
        monkeypatch.setattr(module, "BLOCK_ROWS", 3)
        monkeypatch.setattr(module, "BLOCK", 2)
        monkeypatch.setattr(module, "GUESTS", 3)
        monkeypatch.setattr(module, "CHUNK", 50)
        monkeypatch.setattr(module, "PAIRS_AT_ONCE", 7)
    if seed > 3:
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(module, "LONG_LIST", 3)
        monkeypatch.setattr(module, "LEADERS", 1)
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_sets_move_once_and_in_slices(spark, monkeypatch):
    """With more pairs than are broadcast, sets are not moved by a join, and of equal sets in several tasks one is read."""
    monkeypatch.setattr(module, "BROADCAST_ROWS", 400)
    monkeypatch.setattr(module, "DEALT_ROWS", 300, raising=False)
    texts = [" ".join(f"w{i // 4}x{j}" for j in range(60 + i % 4)) for i in range(40)]
    nodes = module.Sets([t.encode() for t in texts], 5).names.tolist()
    docs = spark.createDataFrame([(i + 100 * c, t) for c in range(2) for i, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    scratch, steps, cut = module.Scratch(spark), [], module.Scratch.cut
    monkeypatch.setattr(module.Scratch, "cut", lambda self, df: steps.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(self, df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = module.rows_of(module.keyed(docs, "doc_id", "text"), 5, spark.createDataFrame([(x,) for x in nodes], "node long"), scratch)
        pairs = spark.createDataFrame([(x, y) for i, x in enumerate(nodes) for y in nodes[:i]], "home long, guest long")
        got = {(r.a, r.b) for r in module.verified(pairs, rows, 80, 4, scratch).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {tuple(sorted((nodes[i], nodes[j]))) for i in range(40) for j in range(i) if i // 4 == j // 4}
    assert rows.first.count() == 40 < rows.sets.count()
    links = [plan for columns, plan in steps if columns == ["a", "b"]]
    assert len(links) == 3 and not any("SortMergeJoin" in plan for plan in links)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)] + [(203, 201), (202, 203), (202, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(40)}, 201: 201, 202: 201, 203: 201}


def test_empty_ties_and_clashes(spark):
    assert ngram_jaccard(spark.createDataFrame([], "doc_id long, text string, h int")).count() == 0
    tied = spark.createDataFrame([(4, "a b", 1), (4, "a b", 1), (2, "A  b", 2), (3, "x", 3)], "doc_id long, text string, node int")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(tied).collect()) == [(2, 1, 2), (3, 1, 3), (4, 1, 2), (4, 1, 2)]


def test_one_of_each_group_stays(spark):
    """Rows of equal ids and different texts stand for themselves; equal rows are one; nothing is lost."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, b, "s"), (7, b, "s"), (None, "alone here", "t"), (9, None, "u"), (9, None, "u"), (8, "", "v"), (3, "same words", "w"), (3, "same words", "w")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert got.columns == ["doc_id", "text", "key"]
    assert sorted((r.doc_id or 0, r.text or "", r.key) for r in got.collect()) == sorted([(1, a, "p"), (5, b, "r"), (0, "alone here", "t"), (9, "", "u"), (9, "", "u"), (8, "", "v"), (3, "same words", "w")])
    nulls = spark.createDataFrame([(None, a), (None, a + " more"), (4, a)], "doc_id long, text string")
    assert [r.doc_id for r in keep_one(nulls).collect()] == [None]
    assert keep_one(nulls.limit(0)).count() == 0


def test_keep_one_keeps_columns_of_any_name(spark):
    text = "one two three four five six seven"
    rows = [(text, 77, "p", True, 1.0, 5, 3), (text, 99, "q", False, 2.0, 6, 1), ("other words", 77, "r", None, 3.0, 7, 2)]
    docs = spark.createDataFrame(rows, "text string, __id long, __key string, __stays boolean, at double, OWN int, doc_id long")
    got = keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted([rows[1], rows[2]])
