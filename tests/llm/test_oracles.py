"""Queries against their SQL in DuckDB, and the pipeline against brute-force versions of its stages."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from siltsieve.llm import queries, toxicity
from siltsieve.llm.tokenizer_chunks import word_piece_ids
from test_ngram_jaccard import brute as brute_jaccard
from test_quality_rules import brute as brute_counts
from test_substring_dedup import brute as brute_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted(str([r[x] for x in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_pipeline_against_brute_force(spark):
    import public_tokenizers

    out = corpus_pipeline.run(spark, SF).collect()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = []
    for d, t in rows:  # no host of these data is rejected
        n = brute_counts(t)
        if not (n[0] < 50 or 100 * n[4] > 50 * n[0]):
            kept.append((d, t))
    kept = [(d, t) for d, t in kept if brute_jaccard(kept)[d][1] == d] if len(kept) < 2 else (lambda c: [(d, t) for d, t in kept if c[d][1] == d])(brute_jaccard(kept))
    left = {d: t for d, t in brute_dedup(kept).items() if t.strip() or not dict(kept)[d].strip()}
    got = {r.doc_id: r.doc_tokens for r in out}
    ids = word_piece_ids(public_tokenizers.path("word_bpe_49k.json"))
    names = sorted(left)
    _, n = ids.ids([left[d].encode() for d in names])
    assert got == {d: int(k) + 1 for d, k in zip(names, n, strict=True)}
    assert sum(r.length for r in out) == sum(got.values())


def test_stages_keep_columns_and_pass_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_stages_with_nulls_ties_and_more_columns(spark):
    t = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, t, "en", "s", 9, "x", 1), (1, t, "en", "s", 9, "x", 1), (2, t.upper(), None, None, None, None, 2), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, h int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        left = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        want = {"quality rules": [1, 1, 2], "n-gram Jaccard join": [1, 3, None], "toxicity": [1, 1, 2, 3, None], "substring dedup": [1, 1, 2, 3, None]}[name]
        assert left == [(d is None, d or 0) for d in want], name
