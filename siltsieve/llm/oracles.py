"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import LIMIT
from .warc_fixity import FILE_RECORDS, GROUP_FILES, RANGE_BYTES

WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 cc(d, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, cc.root FROM cc JOIN e ON cc.d = e.a)
SELECT d AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM cc LEFT JOIN n ON d = doc_id GROUP BY d"""

_RULES = {"base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > n_words", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words"}


def _shrunk(rule: str) -> str:
    """The prior of a rule by the method of moments, and whether a host's shrunk rate is too high."""
    return f"""m_{rule} AS (SELECT least(greatest(avg(f_{rule} / n), 1e-4), 1 - 1e-4) AS m, coalesce(var_samp(f_{rule} / n), 0) AS v, avg(1 / n) AS i FROM h),
 s_{rule} AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * i, m * (1 - m) * 1e-3) - 1, 2), 1000) AS s FROM m_{rule}),
 r_{rule} AS (SELECT host, (f_{rule} + m * s) / (n + s) > {LIMIT} AS bad FROM h, s_{rule})"""


QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS x FROM d),
 twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) z WHERE n > 1),
 covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i FROM twice UNION ALL SELECT doc_id, i + 1 FROM twice UNION ALL SELECT doc_id, i + 2 FROM twice) z GROUP BY doc_id),
 ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS x FROM d),
 c AS (SELECT d.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ln.x) - len(list_distinct(ln.x)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN covered ON d.doc_id = covered.doc_id),
 h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS DOUBLE) AS f_{r}" for r, c in _RULES.items())} FROM c WHERE host IS NOT NULL GROUP BY host),
 {", ".join(_shrunk(r) for r in _RULES)},
 bad AS (SELECT host, bool_or(bad) AS bad FROM ({" UNION ALL ".join(f"SELECT * FROM r_{r}" for r in _RULES)}) z GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["base"]}) AS base_failed, NOT ({_RULES["base"]}) AND NOT coalesce(bad, false) AS kept, coalesce(bad, false) AS host_rejected FROM c LEFT JOIN bad ON c.host = bad.host"""


def _replica(k: int, version: str, pages: str = "pages") -> str:
    end = "chr(13) || chr(10)"
    data = f"{version} || {end} || 'WARC-Type: resource' || {end} || 'WARC-Target-URI: ' || coalesce(url, '') || {end} || 'Content-Type: text/html' || {end} || 'Content-Length: ' || strlen(coalesce(html, '')) || {end} || {end} || coalesce(html, '') || {end} || {end}"
    return f"""a{k} AS (SELECT page_id, coalesce(CAST(floor(page_id / {FILE_RECORDS}) AS BIGINT), -1) AS file, {data} AS data FROM {pages}),
 b{k} AS (SELECT page_id, file, CAST(strlen(data) AS BIGINT) AS length, sha256(data) AS sha256 FROM a{k}),
 c{k} AS (SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha256 ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM b{k}),
 d{k} AS (SELECT *, CAST(floor("offset" / {RANGE_BYTES}) AS BIGINT) AS range_index FROM c{k}),
 e{k} AS (SELECT file, range_index, sha256(string_agg("offset" || ':' || length || ':' || sha256, ',' ORDER BY "offset")) AS hash FROM d{k} GROUP BY ALL),
 f{k} AS (SELECT file, CAST(floor(file / {GROUP_FILES}) AS BIGINT) AS grp, sha256(string_agg(range_index || ':' || hash, ',' ORDER BY range_index)) AS hash FROM e{k} GROUP BY ALL),
 g{k} AS (SELECT grp, sha256(string_agg(file || ':' || hash, ',' ORDER BY file)) AS hash FROM f{k} GROUP BY ALL),
 r{k} AS (SELECT sha256(string_agg(grp || ':' || hash, ',' ORDER BY grp)) AS hash FROM g{k})"""


_OTHER = "(SELECT page_id, url, html FROM pages WHERE page_id % 1013 <> 499 UNION ALL SELECT -1000 - page_id, url, html FROM pages WHERE page_id % 503 = 17) z"
WARC_FIXITY = f"""WITH {_replica(1, "'WARC/1.0'")}, {_replica(2, "CASE WHEN page_id % 101 = 7 THEN 'WARC/1.1' ELSE 'WARC/1.0' END", _OTHER)}
SELECT coalesce(d1.page_id, d2.page_id) AS page_id, coalesce(d1.file, d2.file) AS file, coalesce(d1."offset", d2."offset") AS "offset", coalesce(d1.length, d2.length) AS length, coalesce(d1.sha256, d2.sha256) AS sha256,
 coalesce(d1.range_index, d2.range_index) AS range_index, e1.hash AS range_hash, (SELECT hash FROM r1) AS root_hash, (SELECT hash FROM r2) AS replica_root_hash,
 CASE WHEN d1.page_id IS NULL THEN 'extra' WHEN d2.page_id IS NULL THEN 'missing' WHEN d1.sha256 <> d2.sha256 THEN 'corrupt' WHEN d1."offset" <> d2."offset" THEN 'moved' ELSE 'ok' END AS status
FROM d1 LEFT JOIN e1 ON d1.file = e1.file AND d1.range_index = e1.range_index FULL JOIN d2 ON d1.page_id = d2.page_id"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""k AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
 c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, x AS c FROM k ORDER BY sha256('1:' || vec_id) LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, x, min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'j': j}}) AS m FROM k, c{i} GROUP BY vec_id, x)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT m.j AS j, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(p) GROUP BY m.j, p),
 l{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM s{i} GROUP BY j),
 c{i + 1} AS (SELECT c{i}.j, coalesce(l{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN l{i} ON c{i}.j = l{i}.j)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON m.j = c{rounds}.j"""


CENTROID_CLUSTERS = _clusters()

SQL = {"op5_quality_rules": QUALITY_RULES, "op6_ngram_jaccard": NGRAM_JACCARD, "op13_centroid_clusters": CENTROID_CLUSTERS, "op10_warc_fixity": WARC_FIXITY}
