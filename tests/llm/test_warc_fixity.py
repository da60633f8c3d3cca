from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from siltsieve.llm import warc_fixity as w
from siltsieve.llm.queries import op10_warc_fixity

PAGES = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.0\r\n</p>"), (2, None, "b"), (3, "http://c/", None), (1500, "http://d/", "d" * 400_000), (1501, "http://e/", "e"), (None, "http://f/", "f"), (7, "http://g/", "g"), (7, "http://g/", "g")]


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = w.records(pages)
    w.write_warc(rows, str(tmp_path / "warc"))
    back = w.read_warc(spark, str(tmp_path / "warc"))
    want = {(r.file, r.offset, r.length, r.sha256) for r in w.fixity(rows).collect()}
    assert {(r.file, r.offset, r.length, r.sha256) for r in back.collect()} == want and len(want) == len(PAGES)
    assert {(r.url, bytes(r.body).decode()) for r in back.collect()} == {(u or "", h or "") for _, u, h in PAGES}
    for p in Path(tmp_path / "warc").rglob("part-*"):
        data = p.read_bytes()
        file = int(p.parent.name.split("=")[1])
        for f, at, n, sha in want:
            if f == file:
                assert hashlib.sha256(data[at : at + n]).hexdigest() == sha


def test_audit_finds_each_kind(spark):
    pages = spark.createDataFrame([(i, f"http://{i}/", "x" * (i * 37 % 5000)) for i in range(3000)], "page_id long, url string, html string")
    one = w.Tree(w.fixity(w.records(pages)))
    assert w.audit(one, w.Tree(w.fixity(w.records(pages.repartition(7))))).count() == 0
    other = pages.withColumn("html", F.when(F.col("page_id") == 1234, F.concat(F.lit("y"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    assert [(r.record_id, r.status) for r in w.audit(one, w.Tree(w.fixity(w.records(other)))).collect()] == [(1234, "corrupt")]
    less = w.audit(one, w.Tree(w.fixity(w.records(pages.where("page_id <> 2990"))))).collect()
    assert {(r.record_id, r.status) for r in less} == {(2990, "missing"), *((i, "moved") for i in range(2991, 3000))}
    more = w.audit(w.Tree(w.fixity(w.records(pages.where("page_id <> 2999")))), one).collect()
    assert [(r.record_id, r.status) for r in more] == [(2999, "extra")]


def test_query_against_brute_force(spark):
    pages = {p.page_id: p for p in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    rows = op10_warc_fixity(spark, "/root/testdata/sf0.1").collect()

    def replica(ids, damaged):
        out, at = {}, {}
        for i in sorted(ids):
            p = pages[i if i >= 0 else -1000 - i]
            first = "WARC/1.1" if damaged and i >= 0 and i % 101 == 7 else "WARC/1.0"
            data = f"{first}\r\nWARC-Type: resource\r\nWARC-Target-URI: {p.url}\r\nContent-Type: text/html\r\nContent-Length: {len(p.html.encode())}\r\n\r\n{p.html}\r\n\r\n".encode()
            out[i] = (i // 1000, at.get(i // 1000, 0), len(data), hashlib.sha256(data).hexdigest())
            at[i // 1000] = out[i][1] + len(data)
        return out

    one = replica(pages, False)
    two = replica([i for i in pages if i % 1013 != 499] + [-1000 - i for i in pages if i % 503 == 17], True)
    want = {}
    for i in one.keys() | two.keys():
        a, b = one.get(i), two.get(i)
        want[i] = (*(a or b), "extra" if a is None else "missing" if b is None else "corrupt" if a[3] != b[3] else "moved" if a != b else "ok")
    assert {r.page_id: (r.file, r.offset, r.length, r.sha256, r.status) for r in rows} == want and len(rows) == len(want)
    assert {w[4] for w in want.values()} >= ({"ok", "corrupt", "extra"} if len(pages) < 499 else {"ok", "corrupt", "extra", "missing", "moved"})
    assert all((r.range_hash is None) == (r.status == "extra") for r in rows)


def test_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, file int, data int")
    assert w.fixity(w.records(none)).count() == 0
    assert w.audit(w.Tree(w.fixity(w.records(none))), w.Tree(w.fixity(w.records(none)))).count() == 0
    tied = spark.createDataFrame([(1, "u", "h", 2)] * 3 + [(None, None, None, None)], "page_id long, url string, html string, file int")
    assert [r.status for r in w.fixity_report(tied, w.records(tied, F.lit("WARC/1.1"))).collect()] == ["corrupt"] * 4
