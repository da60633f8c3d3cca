from __future__ import annotations

import random

import numpy as np
import pytest

from siltsieve.llm import toxicity as t
from siltsieve.llm.queries import op4_toxicity


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    return docs, labels, t.train(docs, labels)


def test_neighbours_are_exact(trained):
    index = trained[2]
    r = random.Random(3)
    n = len(index.idf)
    for _ in range(200):
        term = np.array(sorted(r.sample(range(n), min(n, r.randint(1, 12)))))
        w = index.vector(term, np.array([r.randint(1, 5) for _ in term]))
        best, sim = index.nearest(term, w, 8)
        every = w @ index.weights[term]
        want = np.sort(every[every > 0])[::-1][:8]
        assert np.allclose(sim, want, atol=1e-5) and np.allclose(every[best], sim, atol=1e-5)


def test_held_out_accuracy(spark, trained):
    rows = {r.doc_id: r for r in op4_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(rows[x.doc_id].score, rows[x.doc_id].predicted, x.toxic) for x in labels if rows[x.doc_id].held_out]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows.values())
    caught = np.mean([p for _, p, y in held if y])
    wrong = np.mean([p for _, p, y in held if not y])
    assert caught > 0.75 and wrong < 0.01, (caught, wrong)
    brier = np.mean([(s - y) ** 2 for s, _, y in held])
    assert brier < 0.02, brier


def test_labels_held_out_do_not_matter(spark, trained):
    from pyspark.sql import functions as F

    docs, labels, index = trained
    other = labels.withColumn("toxic", F.when(t.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = t.train(docs, other)
    assert np.array_equal(again.weights, index.weights) and (again.slope, again.shift) == (index.slope, index.shift)


def test_edges(spark, trained):
    docs, labels, index = trained
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "pathetic " * 20_000, 3)], "doc_id long, text string, score int")
    got = t.score(odd, index).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id}) == 1 and all(r.predicted == 0 for r in got if r.doc_id)
    assert t.score(odd.limit(0), index).count() == 0
    empty = t.train(docs, labels.limit(0))
    assert {r.predicted for r in t.score(odd, empty).collect()} == {0}
    assert t.train(docs.limit(0), labels).weights.shape[1] == 0


def test_all_terms_count(spark):
    """No term is left out of the index or of a norm, also in a small sample without strong terms."""
    ids = list(range(400))
    texts = {i: f"common{i % 7} words{i % 5} here " + ("zlorp" if i % 10 == 0 else f"calm{i % 3}") + f" only{i}" for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = t.train(docs, spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids[:60]], "doc_id long, toxic int"))
    every = set(np.concatenate([t.distinct_terms([texts[int(i)].encode()])[1] for i in index.ids]).tolist())
    assert len(index.idf) == len(every) and (index.idf > 0).all()
    some = texts[int(index.ids[0])]
    new = " ".join(f"unheard{j}" for j in range(500))
    rows = [(1, some), (2, some.split()[0] + " " + new)]
    got = {r.doc_id: r.evidence for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), index).collect()}
    assert got[1][0].doc_id == int(index.ids[0]) and abs(got[1][0].similarity - 1) < 1e-5
    assert 0 < got[2][0].similarity < 0.5


def test_scores_from_texts(spark):
    """Cosines, votes and scores against plain Python that starts from the texts."""
    import math
    import re
    from collections import Counter

    r = random.Random(5)
    words = [f"{a}{b}" for a in ("plain", "calm", "stone", "river", "odd", "vile") for b in ("", "s", "ly", "ness", "x1", "é")]
    texts = {i: " ".join(r.choices(words[-6:] if i % 9 == 0 and r.random() < 0.5 else words, k=r.choice([0, 1, 4, 30, 200]))) for i in range(500)}
    labels = {i: int(i % 9 == 0) for i in range(0, 500, 2)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    index = t.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))

    def terms(text: str) -> Counter:
        own = [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]
        return Counter([(0, w) for w in own] + [(1, w.encode()[:4]) for w in own])

    bags = {i: terms(x) for i, x in texts.items()}
    ids = sorted(i for i in index.ids.tolist())
    assert set(ids) == {i for i in labels if bags[i] and i not in {x.doc_id for x in docs.where(t.held_out("doc_id")).collect()}}
    all_ids = [i for i in labels if not any(i == x.doc_id for x in docs.where(t.held_out("doc_id")).collect())]
    df = Counter(x for b in bags.values() for x in b)
    inside, toxic = Counter(x for i in ids for x in bags[i]), Counter(x for i in ids if labels[i] for x in bags[i])
    n_toxic, n_clean = sum(labels[i] for i in ids), sum(1 - labels[i] for i in ids)

    def gain(x: tuple) -> float:
        if x not in inside:
            return (math.log((1 + 500) / (1 + 500 / (1 + len(all_ids)))) + 1) * t.LEAST_FACTOR
        p = inside[x] / len(ids)
        d = toxic[x] / n_toxic - (inside[x] - toxic[x]) / n_clean
        rr = d * d * n_toxic * n_clean / len(ids) ** 2 / max(p * (1 - p), 1e-12)
        return (math.log(501 / (1 + df[x])) + 1) * (t.LEAST_FACTOR + rr / (rr + t.HALF**2))

    def vector(bag: Counter) -> dict:
        v = {x: (1 + math.log(n)) * gain(x) for x, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    vectors = {i: vector(b) for i, b in bags.items() if b}
    for row in t.score(docs, index).collect():
        if not bags[row.doc_id]:
            continue
        v = vectors[row.doc_id]
        sims = sorted(((sum(w * vectors[i].get(x, 0) for x, w in v.items()), i) for i in ids), reverse=True)[: t.NEIGHBOURS]
        assert np.allclose([e.similarity for e in row.evidence], [s for s, _ in sims[: t.SHOWN] if s > 0], atol=1e-4)
        if sims[-1][0] - sorted((sum(w * vectors[i].get(x, 0) for x, w in v.items()) for i in ids), reverse=True)[t.NEIGHBOURS] > 1e-5:  # no tie at the edge
            vote = (sum(s * s * labels[i] for s, i in sims) + index.none) / (sum(s * s for s, _ in sims) + 1)
            assert abs(row.score - 1 / (1 + math.exp(-(index.slope * math.log(vote / (1 - vote)) + index.shift)))) < 1e-3
