from __future__ import annotations

import re
from collections import Counter

from siltsieve.llm.quality_rules import keep_good, quality_rules

ODD = ["", " ", "\n\n", "a", "a b c a b c", "a a a a", "x" * 9000, "é ü ß # $ |", "l\nl\n l\nl", "one two three " * 40, "same line here\n" * 60, "\x0b\x0c\t a\x1cb"]


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(10_000 + i, t, None if i % 2 else "odd") for i, t in enumerate([*ODD, None])], "doc_id long, text string, source string"))
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for r in docs.collect():
        g, want = got.pop(r.doc_id), brute(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, r.text
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.kept and g.base_failed) and g.source == r.source
    assert not got


def test_bad_host_is_rejected_and_small_ones_are_not(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 20 == 0 else "too short", "bad.example") for i in range(400)]
    rows += [(1000 + 100 * h + i, good if i else "too short", f"good{h}.example") for h in range(20) for i in range(20)]
    rows += [(9000, "too short", "tiny.example"), (9001, good, "tiny.example"), (9002, good, None)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].host_rejected and not got[0].kept and not got[0].base_failed
    assert got[1001].kept and got[9001].kept and got[9002].kept and not got[9000].kept


def test_empty_and_clashing_columns(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string, n int, host string")).count() == 0
    rows = quality_rules(spark.createDataFrame([(1, "a b", "s", 1, "h", True), (1, "a b", "s", 1, "h", True)], "doc_id long, text string, source string, n int, host string, kept boolean")).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in rows] == [(1, 2, False)] * 2


def test_keep_good_reads_no_column_by_its_place(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(good, "s", "x", None), ("short", "s", "y", 2), (None, None, None, None)], "text string, source string, row string, doc_id long")
    assert [tuple(r) for r in keep_good(docs).collect()] == [(good, "s", "x", None)]
