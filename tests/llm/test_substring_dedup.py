from __future__ import annotations

import random
import re

import numpy as np

from pyspark.sql import Row

from siltsieve.llm.substring_dedup import LONG, MIN_SENTENCES, MIN_WORDS, spans, substring_dedup
from siltsieve.llm.wordhash import Words


def units(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first byte, end byte, words) of each sentence, word by word."""
    data = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not words:
        return []
    ends = []
    for i, (a, b) in enumerate(words):
        gap = data[b : words[i + 1][0]] if i + 1 < len(words) else b"\n"
        ends.append(bool(re.search(rb"([.!?]|(?<=[.!?])[\"')\]])$", data[a:b])) or b"\n" in gap)
    ends[-1] = True
    out, held = [], []
    for i in range(len(words)):
        held.append(i)
        if ends[i]:
            if len(held) > LONG:
                hashes = Words([data[words[j][0] : words[j][1]] for j in held]).hashes
                hashes = hashes.tolist()
                cuts = {max(range(a, a + LONG), key=lambda j: (-hashes[j], j)) for a in range(len(held) - LONG + 1)} | {0}
                edges = [*sorted(cuts), len(held)]
                out += [held[a:b] for a, b in zip(edges, edges[1:])]
            else:
                out.append(held)
            held = []
    begins = [words[u[0]][0] for u in out] + [len(data)]
    return [(begins[k], begins[k + 1], tuple(data[words[j][0] : words[j][1]] for j in u)) for k, u in enumerate(out)]


def brute(rows: list[tuple[int, str]]) -> dict[int, str]:
    seen, gone = set(), {}
    for d, text in sorted(rows):
        own = units(text)
        for i in range(len(own)):
            j = i
            while j < len(own) and (j - i < MIN_SENTENCES or sum(len(u[2]) for u in own[i:j]) < MIN_WORDS):
                j += 1
            run = own[i:j]
            if len(run) < MIN_SENTENCES or sum(len(u[2]) for u in run) < MIN_WORDS:
                continue
            key = tuple(w for u in run for w in u[2])
            if key in seen:
                gone.setdefault(d, []).extend(range(run[0][0], run[-1][1]))
            seen.add(key)
    out = {}
    for d, text in rows:
        drop = set(gone.get(d, ()))
        out[d] = bytes(x for i, x in enumerate(text.encode()) if i not in drop).decode()
    return out


def passages(seed: int) -> list[tuple[int, str]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))

    def some(n: int) -> str:
        out = ""
        while n > 0:
            k = r.choice([1, 3, 8, 12, 30])
            out += " ".join(word() for _ in range(k)) + r.choice([". ", "! ", "? ", ".\n", "\n", '." ', " .) "])
            n -= k
        return out

    shared = [some(60) for _ in range(6)] + [" ".join(word() for _ in range(80)), some(12)]
    out = []
    for _ in range(60):
        parts = [some(r.choice([0, 5, 40, 100])) for _ in range(r.randint(1, 3))]
        for _ in range(r.choice([0, 1, 2])):
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared) + r.choice(["", " ", "\n\n"]))
        out.append("".join(parts))
    out += ["", " \n ", out[0], out[0], "x. " * 200, "a\x1cb. c! " * 30]
    return list(zip(r.sample(range(-500, 9000), len(out)), out, strict=True))


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = passages(seed)
        got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
        want = brute(rows)
        assert {d: r.text for d, r in got.items()} == want
        text = dict(rows)
        for d, r in got.items():
            assert len(text[d].encode()) - sum(x.end - x.begin for x in r.removed) == len(r.text.encode())
        assert sum(len(text[d]) > len(t) for d, t in want.items()) > 20


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id: r.text for r in substring_dedup(docs).collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_planted_passage_is_kept_once(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ". "
    passage = "".join(sentence(11) for _ in range(6))
    rows = [(i, sentence(9) * 1 + sentence(7) + passage + sentence(10)) for i in range(40)] + [(100 + i, sentence(12) + sentence(9) + sentence(15)) for i in range(40)]
    got = {x.doc_id: x.text for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(passage.strip() in t for t in got.values()) == 1 and passage.strip() in got[0]
    assert all(got[d] == t for d, t in rows if d >= 100)


def test_edges(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string, begin int")).count() == 0
    t = "One two three four five six seven. Eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone."
    rows = [(1, t, 7, "a"), (1, t, 7, "a"), (1, t + " More.", 8, "b"), (None, None, 9, "c"), (2, t, None, "d")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, key int, removed string")).collect()
    assert sorted((x.doc_id or 0, x.key or 0, x.text) for x in got)[0] == (0, 9, None)
    # Two equal rows and one of the same id: one of the two texts keeps the passage.
    kept = [x.text for x in got if x.doc_id == 1]
    assert len(kept) == 3 and {x.text for x in got if x.doc_id == 2} == {""}
    assert t in kept[0] or t in kept[2]


def test_any_passage_of_50_words_holds_a_span(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))

    def words(n: int, kind: int) -> list[str]:
        if kind == 2:  # few distinct words
            return [r.choice("abc") for _ in range(n)]
        ends = {0: [], 1: [15], 3: [3, 14, 15, 16, 31]}[kind]
        stops = np.cumsum(r.choices(ends, k=n)) if ends else []
        return [word() + ("." if i in stops else "") for i in range(n)]

    missed, rows = 0, []
    for case in range(400):
        kind, n = case % 4, MIN_WORDS + 2 * LONG
        source, other = words(200, kind), words(100, kind)
        at, to = r.randrange(150), r.randrange(100)
        copy = other[:to] + source[at : at + n] + other[to:]
        a, b = (" ".join(x).encode() for x in (source, copy))
        (h, *_), (g, _, begin, end) = spans([a]), spans([b])
        p, q = (len(" ".join(copy[:k])) for k in (to, to + n))
        missed += not any(x in set(h.tolist()) and p <= y and z <= q + 1 for x, y, z in zip(g.tolist(), begin.tolist(), end.tolist(), strict=True))
        rows += [(2 * case, a.decode()), (2 * case + 1, b.decode())] if kind != 2 else []
    assert not missed
    got = {x.doc_id: x.removed for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(bool(v) == bool(d % 2) for d, v in got.items())


def test_columns_of_any_name(spark):
    passage = " ".join(f"shared{i}" for i in range(60)) + "."
    rows = [(f"{passage} end {i}.", f"k{i}", i, 10 * i, True, 1.5, i) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "text string, __key string, __doc int, doc int, key boolean, SPANS double, doc_id long")
    got = sorted(substring_dedup(docs).collect(), key=lambda r: r.doc_id)
    assert got[0].asDict() == dict(zip(docs.columns, rows[0])) | {"removed": []}
    cut = got[1].removed[0].end
    assert got[1].asDict() == dict(zip(docs.columns, rows[1])) | {"text": rows[1][0][cut:], "removed": [Row(begin=0, end=cut)]} and cut > 300
