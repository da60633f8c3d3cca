"""One query for each operator over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import pane
from ..functions.rules import Rule, intersecting, parse_rule
from ..operators import arrival, classes, detect, dynamics, repair
from ..sources import lines
from .cleaner import Cleaner
from .fixtures import COLUMNS, DIRTY_SQL, EVENT_RULES, EVENTS_SQL, RULES, dirty_orders, event_stream

STEP, EVENT_STEP, WORKERS, TOP = 500, 2000, 3, 5
CUT = 500  # where rules come and go

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = (f, sql)
        return f

    return add


U = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
B = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def cond(rule: Rule) -> str:
    own = []
    if rule.cond_attr:
        own.append(f"{rule.cond_attr} = '{rule.cond_val}'" if rule.op == "eq" else f"{rule.cond_attr} <> '{rule.cond_val}' AND {rule.cond_attr} <> ''")
    if rule.from_tid is not None:
        own.append(f"tid >= {rule.from_tid}")
    if rule.to_tid is not None:
        own.append(f"tid < {rule.to_tid}")
    return " AND ".join(own) or "true"


def s_sql(rule: Rule, name: str = "s", table: str = "dirty") -> str:
    return f"{name} AS (SELECT kid, tid, {rule.lhs} AS l, {rule.rhs} AS r FROM {table} WHERE {cond(rule)})"


def det_sql(name: str = "d", s: str = "s") -> str:
    """Prefix detection: violating and new for each tuple of s."""
    return f"""{name} AS (SELECT *, min(r) OVER w <> max(r) OVER w AS vio, coalesce(min(r) OVER b = max(r) OVER b, false) AS one_before FROM {s}
 WINDOW w AS (PARTITION BY l ORDER BY tid {U}), b AS (PARTITION BY l ORDER BY tid {B}))"""


def pane_sql(step: int, s: str = "s") -> str:
    """Detection over two panes: det with vio, one_before and pane p."""
    return f"""b AS (SELECT *, CAST(floor((tid - 1) / {step}) AS BIGINT) + 1 AS p FROM {s}),
 pa AS (SELECT l, p + 1 AS p, min(r) AS mn, max(r) AS mx FROM b GROUP BY l, p),
 det AS (SELECT b.*, least(min(b.r) OVER w, pa.mn) <> greatest(max(b.r) OVER w, pa.mx) AS vio,
  coalesce(least(min(b.r) OVER v, pa.mn) = greatest(max(b.r) OVER v, pa.mx), false) AS one_before
  FROM b LEFT JOIN pa ON b.l = pa.l AND b.p = pa.p WINDOW w AS (PARTITION BY b.l, b.p ORDER BY b.tid {U}), v AS (PARTITION BY b.l, b.p ORDER BY b.tid {B}))"""


NONE_SQL = f"""c AS (SELECT *, count(*) OVER (PARTITION BY l, r ORDER BY tid {U}) AS c FROM s),
 f AS (SELECT *, min(r) OVER w <> max(r) OVER w AS vio, min({{'a': -c, 'v': r}}) OVER w AS m FROM c WINDOW w AS (PARTITION BY l ORDER BY tid {U})),
 fixed AS (SELECT kid, tid, r, vio AS violating, CASE WHEN vio THEN CASE WHEN c = -m.a THEN r ELSE m.v END END AS fix FROM f)"""
BASIC_SQL = f"""pv AS (SELECT l, p + 1 AS p, r, count(*) AS n FROM b GROUP BY l, p, r),
 pb AS (SELECT l, p, min({{'a': -n, 'v': r}}) AS pm FROM pv GROUP BY l, p),
 c AS (SELECT det.*, coalesce(pv.n, 0) + count(*) OVER (PARTITION BY det.l, det.p, det.r ORDER BY det.tid {U}) AS c
  FROM det LEFT JOIN pv ON det.l = pv.l AND det.p = pv.p AND det.r = pv.r),
 f AS (SELECT c.*, least(min({{'a': -c, 'v': r}}) OVER (PARTITION BY c.l, c.p ORDER BY c.tid {U}), coalesce(pm, {{'a': CAST(0 AS BIGINT), 'v': ''}})) AS m
  FROM c LEFT JOIN pb ON c.l = pb.l AND c.p = pb.p),
 fixed AS (SELECT kid, tid, r, vio AS violating, CASE WHEN vio THEN CASE WHEN c = -m.a THEN r ELSE m.v END END AS fix FROM f)"""
CUMULATIVE_SQL = f"""vp AS (SELECT DISTINCT l, p FROM det WHERE vio),
 isl AS (SELECT l, p, p - row_number() OVER (PARTITION BY l ORDER BY p) AS g FROM vp),
 ep AS (SELECT l, p, min(p) OVER (PARTITION BY l, g) AS birth FROM isl),
 epx AS (SELECT l, p, birth FROM ep UNION ALL SELECT l, birth - 1, birth FROM (SELECT DISTINCT l, birth FROM ep) z),
 e AS (SELECT det.*, birth FROM det JOIN epx ON det.l = epx.l AND det.p = epx.p),
 c AS (SELECT *, count(*) OVER (PARTITION BY l, birth, r ORDER BY tid {U}) AS c FROM e),
 f AS (SELECT *, min({{'a': -c, 'v': r}}) OVER (PARTITION BY l, birth ORDER BY tid {U}) AS m FROM c),
 fixed AS (SELECT det.kid, det.tid, det.r, det.vio AS violating, CASE WHEN det.vio THEN CASE WHEN f.c = -f.m.a THEN f.r ELSE f.m.v END END AS fix
  FROM det LEFT JOIN f ON det.tid = f.tid AND f.vio)"""


def classes_sql(rules: list[Rule], live: str = "true") -> str:
    """Classes of the final state: cell, comp, dc, n, best."""
    m = " UNION ALL ".join(f"SELECT {r.rid} AS rid, {r.lhs} AS l, kid, tid, {r.rhs} AS v FROM dirty WHERE {cond(r)} AND {live}" for r in rules)
    return f"""m AS ({m}), bad AS (SELECT rid, l FROM m GROUP BY rid, l HAVING min(v) <> max(v)),
 cell AS (SELECT m.rid || ':' || m.l AS vc, m.rid AS rid, kid, tid, v FROM m JOIN bad ON m.rid = bad.rid AND m.l = bad.l),
 e AS (SELECT DISTINCT a.vc AS x, b.vc AS y FROM cell a JOIN cell b ON a.kid = b.kid),
 cc(x, root) AS (SELECT DISTINCT vc, vc FROM cell UNION SELECT e.y, cc.root FROM cc JOIN e ON cc.x = e.x),
 comp AS (SELECT x AS vc, min(root) AS root FROM cc GROUP BY x),
 dc AS (SELECT DISTINCT root, kid, v FROM cell JOIN comp ON cell.vc = comp.vc),
 n AS (SELECT root, v, count(*) AS n FROM dc GROUP BY root, v),
 best AS (SELECT root, min({{'a': -n, 'v': v}}) AS m FROM n GROUP BY root)"""


SHARED_FIX = "SELECT dc.kid, CASE WHEN n.n = -m.a THEN dc.v ELSE m.v END AS fix FROM dc JOIN n ON dc.root = n.root AND dc.v = n.v JOIN best ON dc.root = best.root"
PAIR = [RULES[0], RULES[1]]
BOTH_DETECTED = " UNION ALL ".join(f"SELECT kid, tid, {r.rid} AS rid, '{r.rhs}' AS attr, vio, vio AND one_before AS is_new FROM d{r.rid}" for r in PAIR)
PAIR_SQL = f"{DIRTY_SQL}, {s_sql(RULES[0], 's0')}, {s_sql(RULES[1], 's1')}, {det_sql('d0', 's0')}, {det_sql('d1', 's1')}, v AS (SELECT * FROM ({BOTH_DETECTED}) z WHERE vio)"


# Sources and sinks


@query(f"WITH {DIRTY_SQL} SELECT kid, custkey, loc, segment, cname, status FROM dirty")
def parse_delimited(spark, d):  # noqa: ANN001, ANN201
    return lines.parse_delimited(lines.to_lines(dirty_orders(spark, d), COLUMNS), COLUMNS)


@query("SELECT 'del_rule' AS name, r_regionkey || ';' || r_name AS payload FROM region")
def parse_control(spark, d):  # noqa: ANN001, ANN201
    r = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("del_rule|"), F.col("r_regionkey").cast("string"), F.lit(";"), "r_name").alias("value"))
    return lines.parse_control(r)


@query(f"WITH {DIRTY_SQL} SELECT kid, tid FROM dirty WHERE tid % 100 = 0")
def src_probe(spark, d):  # noqa: ANN001, ANN201
    return lines.probes(dirty_orders(spark, d)).select("kid", "tid")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src_file(spark, d):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")


@query(f"WITH {DIRTY_SQL} SELECT CAST(kid AS VARCHAR) || '|' || custkey || '|' || loc || '|' || segment || '|' || cname || '|' || status AS value FROM dirty")
def sink_file(spark, d):  # noqa: ANN001, ANN201
    return lines.to_lines(dirty_orders(spark, d), COLUMNS)


REPAIRED_SQL = f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, {NONE_SQL}"


@query(f"{REPAIRED_SQL} SELECT dirty.kid, custkey, loc, segment, fix AS cname, status FROM dirty JOIN fixed ON dirty.kid = fixed.kid WHERE violating")
def sink_repaired(spark, d):  # noqa: ANN001, ANN201
    return Cleaner([RULES[6]]).repair(dirty_orders(spark, d)).where("repaired").select(*COLUMNS)


@query(f"{REPAIRED_SQL} SELECT dirty.kid, custkey, loc, segment, cname, status FROM dirty JOIN fixed ON dirty.kid = fixed.kid WHERE NOT violating")
def sink_clean(spark, d):  # noqa: ANN001, ANN201
    return Cleaner([RULES[6]]).repair(dirty_orders(spark, d)).where("not repaired").select(*COLUMNS)


# Projections, filters and rules


@query(f"WITH {DIRTY_SQL} SELECT kid FROM dirty WHERE status = 'F'")
def pred_eq(spark, d):  # noqa: ANN001, ANN201
    return dirty_orders(spark, d).where(RULES[3].condition()).select("kid")


@query(f"WITH {DIRTY_SQL} SELECT kid FROM dirty WHERE cname <> 'null' AND cname <> ''")
def pred_neq(spark, d):  # noqa: ANN001, ANN201
    return dirty_orders(spark, d).where(RULES[2].condition()).select("kid")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[2])} SELECT kid, tid, l, r FROM s")
def cfd_filter(spark, d):  # noqa: ANN001, ANN201
    return detect.members(dirty_orders(spark, d), RULES[2]).select("kid", "tid", "l", "r")


@query(f"WITH {DIRTY_SQL} SELECT kid, tid, custkey, segment, cname FROM dirty")
def project_rule_attrs(spark, d):  # noqa: ANN001, ANN201
    return dirty_orders(spark, d).select("kid", "tid", *RULES[2].attributes)


@query(f"WITH {DIRTY_SQL} SELECT tid, kid, custkey AS left_attr, segment AS right_attr, status AS cond_attr FROM dirty")
def sub_tuple(spark, d):  # noqa: ANN001, ANN201
    r = RULES[3]
    return dirty_orders(spark, d).select("tid", "kid", F.col(r.lhs).alias("left_attr"), F.col(r.rhs).alias("right_attr"), F.col(r.cond_attr).alias("cond_attr"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS tid FROM orders")
def assign_tid(spark, d):  # noqa: ANN001, ANN201
    from ..functions.order import with_tid

    return with_tid(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey")


@query(f"WITH {DIRTY_SQL} " + " UNION ALL ".join(f"SELECT kid, tid, {r.rid} AS rid, {r.rid % WORKERS} AS worker, {r.lhs} AS l, {r.rhs} AS r FROM dirty WHERE {cond(r)}" for r in RULES.values()))
def route_rules(spark, d):  # noqa: ANN001, ANN201
    return detect.routed(dirty_orders(spark, d), list(RULES.values()), WORKERS)


@query("SELECT * FROM (VALUES " + ", ".join(f"({r.rid}, '{r.kind}', '{r.lhs}', '{r.rhs}', {repr(r.cond_attr) if r.cond_attr else 'NULL'}, {repr(r.op) if r.op else 'NULL'}, {repr(r.cond_val) if r.cond_val else 'NULL'})" for r in RULES.values()) + ") t(rid, kind, lhs, rhs, cond_attr, op, cond_val)")
def rule_table(spark, d):  # noqa: ANN001, ANN201
    return detect.rule_table(dirty_orders(spark, d), list(RULES.values())).drop("from_tid", "to_tid")


# Detection


def _detected(rule: Rule, table: str = DIRTY_SQL, name: str = "dirty") -> str:
    return f"WITH {table}, {s_sql(rule, table=name)}, {det_sql()} SELECT kid, tid, l, r, vio AND one_before AS is_new FROM d WHERE vio"


_VIOLATION = ["kid", "tid", "l", "r", "is_new"]


@query(_detected(RULES[0]))
def fd_detect(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), RULES[0]).select(_VIOLATION)


@query(_detected(RULES[2]))
def cfd_detect(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), RULES[2]).select(_VIOLATION)


@query(_detected(RULES[4]))
def fd_detect_hot(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), RULES[4]).select(_VIOLATION)


@query(f"""WITH {DIRTY_SQL}, {s_sql(RULES[0])}, {det_sql()} SELECT a.kid, a.tid, a.l, a.r, min(o.r) AS othervalue, CAST(count(*) AS BIGINT) AS n_other, CAST(min(o.tid) AS BIGINT) AS first_other, CAST(sum(o.tid) AS BIGINT) AS sum_other
 FROM d a JOIN s o ON a.l = o.l AND o.tid < a.tid WHERE a.vio AND a.one_before GROUP BY a.kid, a.tid, a.l, a.r""")
def new_violation(spark, d):  # noqa: ANN001, ANN201
    own = detect.other_tuples(dirty_orders(spark, d), RULES[0]).groupBy("kid", "tid", "l", "r", "othervalue")
    return own.agg(F.count("*").alias("n_other"), F.min("other_tid").alias("first_other"), F.sum("other_tid").alias("sum_other"))


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[0])}, {det_sql()} SELECT kid, tid FROM d WHERE vio AND NOT one_before")
def append_violation(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), RULES[0]).where("not is_new").select("kid", "tid")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[3])}, {det_sql()} SELECT kid, tid FROM dirty WHERE kid NOT IN (SELECT kid FROM d WHERE vio)")
def null_violation(spark, d):  # noqa: ANN001, ANN201
    df = dirty_orders(spark, d)
    return detect.clean(df, detect.detect(df, RULES[3])).select("kid", "tid")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[0])} SELECT l, count(DISTINCT r) AS n_values, count(*) AS n_cells, count(DISTINCT r) = 1 AS is_unique FROM s GROUP BY l")
def cell_group(spark, d):  # noqa: ANN001, ANN201
    return detect.cell_groups(dirty_orders(spark, d), RULES[0]).drop("p")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[0])}, {pane_sql(STEP)} SELECT kid, tid, l, r, p, vio AND one_before AS is_new FROM det WHERE vio")
def fd_detect_win(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), RULES[0], STEP).drop("rid")


@query(f"WITH {EVENTS_SQL}, {s_sql(EVENT_RULES[0], table='ev')}, {pane_sql(EVENT_STEP)} SELECT kid, tid, l, r, p, vio AND one_before AS is_new FROM det WHERE vio")
def fd_detect_win_events(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(event_stream(spark, d), EVENT_RULES[0], EVENT_STEP).drop("rid")


@query(f"""WITH {DIRTY_SQL}, {s_sql(RULES[0])}, b AS (SELECT *, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM s), x AS (SELECT l, r, p FROM b UNION ALL SELECT l, r, p + 1 FROM b)
 SELECT l, p, count(DISTINCT r) AS n_values, count(*) AS n_cells, count(DISTINCT r) = 1 AS is_unique FROM x GROUP BY l, p""")
def cell_group_win(spark, d):  # noqa: ANN001, ANN201
    return detect.cell_groups(dirty_orders(spark, d), RULES[0], STEP)


@query(f"WITH {PAIR_SQL} SELECT kid, tid, attr, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS rids, bool_or(is_new) AS coordinate FROM v GROUP BY kid, tid, attr")
def violation_group(spark, d):  # noqa: ANN001, ANN201
    got = detect.violation_groups(detect.detect_all(dirty_orders(spark, d), PAIR))
    return got.withColumn("rids", F.array_join(F.col("rids").cast("array<string>"), ","))


@query(f"WITH {PAIR_SQL} SELECT kid, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY kid")
def gather_by_tid(spark, d):  # noqa: ANN001, ANN201
    return detect.detect_all(dirty_orders(spark, d), PAIR).groupBy("kid").agg(F.count("*").alias("n"))


@query(f"WITH {PAIR_SQL} SELECT kid, tid FROM dirty WHERE kid NOT IN (SELECT kid FROM v)")
def clean_shortcut(spark, d):  # noqa: ANN001, ANN201
    return Cleaner(PAIR).clean(dirty_orders(spark, d)).select("kid", "tid")


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({r.rid}, '{r.rhs}')" for r in RULES.values()) + ") t(rid, rhs)) SELECT a.rid, b.rid AS other_rid FROM r a JOIN r b ON a.rhs = b.rhs AND a.rid <> b.rid")
def intersecting_rules(spark, d):  # noqa: ANN001, ANN201
    return intersecting(detect.rule_table(dirty_orders(spark, d), list(RULES.values())))


@query(f"WITH {PAIR_SQL} SELECT DISTINCT kid, tid FROM v WHERE is_new")
def require_coordinate(spark, d):  # noqa: ANN001, ANN201
    return detect.detect_all(dirty_orders(spark, d), PAIR).where("coordinate").select("kid", "tid").distinct()


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[4])}, g AS (SELECT l, count(DISTINCT r) AS v, count(*) AS c FROM s GROUP BY l) SELECT count(*) AS n_groups, max(v) AS max_values, CAST(max(c) AS BIGINT) AS max_cells FROM g")
def detect_state_stats(spark, d):  # noqa: ANN001, ANN201
    return detect.state_stats(dirty_orders(spark, d), RULES[4])


# Windows


@query(f"WITH {DIRTY_SQL} SELECT kid, tid, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM dirty")
def pane_advance(spark, d):  # noqa: ANN001, ANN201
    return dirty_orders(spark, d).select("kid", "tid", pane(STEP).alias("p"))


@query(f"""WITH {DIRTY_SQL}, b AS (SELECT custkey AS l, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM dirty), x AS (SELECT l, p FROM b UNION ALL SELECT l, p + 1 FROM b) SELECT p, count(DISTINCT l) AS n_keys, count(*) AS n_tuples FROM x GROUP BY p""")
def pane_window(spark, d):  # noqa: ANN001, ANN201
    rows = dirty_orders(spark, d).select(F.col("custkey").alias("l"), pane(STEP).alias("p")).groupBy("l", "p").agg(F.count("*").alias("n"))
    both = rows.unionByName(rows.withColumn("p", F.col("p") + 1)).groupBy("l", "p").agg(F.sum("n").alias("n"))
    return both.groupBy("p").agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_tuples"))


@query(f"""WITH {DIRTY_SQL}, b AS (SELECT DISTINCT custkey AS l, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM dirty) SELECT a.l, a.p FROM b a JOIN b z ON a.l = z.l AND a.p = z.p + 1""")
def touch_promote(spark, d):  # noqa: ANN001, ANN201
    b = dirty_orders(spark, d).select(F.col("custkey").alias("l"), pane(STEP).alias("p")).distinct()
    return b.join(b.withColumn("p", F.col("p") + 1), ["l", "p"])


@query(f"""WITH {DIRTY_SQL}, {s_sql(RULES[0])}, b AS (SELECT *, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM s), x AS (SELECT l, r, p, tid FROM b UNION ALL SELECT l, r, p + 1, tid FROM b)
 SELECT l, r, p, CAST(count(*) AS BIGINT) AS n, CAST(min(tid) AS BIGINT) AS first_tid, CAST(max(tid) AS BIGINT) AS last_tid FROM x GROUP BY l, r, p""")
def supercell_win(spark, d):  # noqa: ANN001, ANN201
    one = detect.members(dirty_orders(spark, d), RULES[0], STEP).groupBy("l", "r", "p").agg(F.count("*").alias("n"), F.min("tid").alias("a"), F.max("tid").alias("b"))
    return one.unionByName(one.withColumn("p", F.col("p") + 1)).groupBy("l", "r", "p").agg(F.sum("n").alias("n"), F.min("a").alias("first_tid"), F.max("b").alias("last_tid"))


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[0])}, {pane_sql(STEP)}, {CUMULATIVE_SQL} SELECT l, birth, r, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY l, birth, r")
def supercell_cumulative(spark, d):  # noqa: ANN001, ANN201
    df = dirty_orders(spark, d)
    lives = repair.episodes(detect.detect(df, RULES[0], STEP).select("l", "p").distinct())
    panes = lives.unionByName(lives.select("l", (F.col("birth") - 1).alias("p"), "birth").distinct())
    return detect.members(df, RULES[0], STEP).groupBy("l", "p", "r").agg(F.count("*").alias("n")).join(panes, ["l", "p"]).groupBy("l", "birth", "r").agg(F.sum("n").alias("n"))


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, {NONE_SQL} SELECT kid, tid, violating, fix FROM fixed")
def window_none(spark, d):  # noqa: ANN001, ANN201
    return repair.repair_rule(dirty_orders(spark, d), RULES[6]).drop("r", "is_new")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, {pane_sql(STEP)}, {BASIC_SQL} SELECT kid, tid, violating, fix FROM fixed")
def window_basic(spark, d):  # noqa: ANN001, ANN201
    return repair.repair_rule(dirty_orders(spark, d), RULES[6], "basic", STEP).drop("r", "is_new")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, {pane_sql(STEP)}, {CUMULATIVE_SQL} SELECT kid, tid, violating, fix FROM fixed")
def window_cumulative(spark, d):  # noqa: ANN001, ANN201
    return repair.repair_rule(dirty_orders(spark, d), RULES[6], "cumulative", STEP).drop("r", "is_new")


@query(f"WITH {EVENTS_SQL}, {s_sql(EVENT_RULES[1], table='ev')}, {pane_sql(EVENT_STEP)}, {CUMULATIVE_SQL} SELECT kid, tid, violating, fix FROM fixed")
def window_cumulative_events(spark, d):  # noqa: ANN001, ANN201
    return repair.repair_rule(event_stream(spark, d), EVENT_RULES[1], "cumulative", EVENT_STEP).drop("r", "is_new")


LIMITED, LIMIT = parse_rule(7, "FD,loc,cname"), 11


@query(f"""WITH RECURSIVE {DIRTY_SQL}, {s_sql(LIMITED)}, {pane_sql(STEP)}, vp AS (SELECT DISTINCT l, p FROM det WHERE vio),
 runs AS (SELECT l, p, min(p) OVER (PARTITION BY l, g) AS birth FROM (SELECT l, p, p - row_number() OVER (PARTITION BY l ORDER BY p) AS g FROM vp) z),
 seen AS (SELECT x.l, x.p AS birth, y.p, count(DISTINCT b.r) AS k FROM vp x JOIN vp y ON x.l = y.l AND y.p >= x.p JOIN b ON b.l = x.l AND b.p BETWEEN x.p - 1 AND y.p GROUP BY ALL),
 walk(l, p, birth) AS (SELECT l, p, birth FROM runs WHERE p = birth UNION ALL
  SELECT runs.l, runs.p, CASE WHEN k > {LIMIT} THEN runs.p ELSE walk.birth END FROM walk JOIN runs ON runs.l = walk.l AND runs.p = walk.p + 1 AND runs.birth <= walk.p
  JOIN seen ON seen.l = walk.l AND seen.birth = walk.birth AND seen.p = walk.p),
 asks AS (SELECT det.kid, det.tid, det.l, det.r, det.p, birth FROM det JOIN walk ON det.l = walk.l AND det.p = walk.p WHERE vio),
 n AS (SELECT asks.tid, b.r, count(*) AS n FROM asks JOIN b ON asks.l = b.l AND b.tid <= asks.tid AND b.p >= asks.birth - 1 GROUP BY ALL),
 best AS (SELECT tid, min({{'a': -n, 'v': r}}) AS m FROM n GROUP BY tid)
 SELECT asks.kid, asks.tid, CASE WHEN n.n = -m.a THEN asks.r ELSE m.v END AS fix FROM asks JOIN n ON asks.tid = n.tid AND asks.r = n.r JOIN best ON asks.tid = best.tid""")
def value_limit_reset(spark, d):  # noqa: ANN001, ANN201
    return repair.repair_rule(dirty_orders(spark, d), LIMITED, "cumulative", STEP, value_limit=LIMIT).where("violating").select("kid", "tid", "fix")


LAST = f"CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 >= (SELECT CAST(floor((max(tid) - 1) / {STEP}) AS BIGINT) FROM dirty)"


def _last_panes(df: DataFrame) -> tuple[int, int]:
    last = df.agg(F.max(pane(STEP))).first()[0] or 0
    return last - 1, last


@query(f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql(PAIR, LAST)} SELECT vc, root FROM comp")
def subgraph_split_on_slide(spark, d):  # noqa: ANN001, ANN201
    df = dirty_orders(spark, d)
    return classes.class_of(classes.cells(df, PAIR, _last_panes(df), STEP))


@query(f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql(PAIR, LAST)} SELECT kid, tid, vc FROM cell")
def cell_vc_window(spark, d):  # noqa: ANN001, ANN201
    df = dirty_orders(spark, d)
    return classes.cells(df, PAIR, _last_panes(df), STEP).select("kid", "tid", "vc")


@query(f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql(PAIR)} SELECT vc, v, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p, CAST(count(*) AS BIGINT) AS n FROM cell GROUP BY ALL")
def vc_cell_group(spark, d):  # noqa: ANN001, ANN201
    return classes.cells(dirty_orders(spark, d), PAIR).groupBy("vc", "v", pane(STEP).alias("p")).agg(F.count("*").alias("n"))


# Classes


SHARED_SQL = f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql(PAIR)}"


@query(f"{SHARED_SQL} SELECT kid, tid, vc FROM cell")
def cell_vc_index(spark, d):  # noqa: ANN001, ANN201
    return classes.cells(dirty_orders(spark, d), PAIR).select("kid", "tid", "vc")


@query(f"{SHARED_SQL} SELECT vc, v, CAST(count(*) AS BIGINT) AS n FROM cell GROUP BY vc, v")
def add_cells(spark, d):  # noqa: ANN001, ANN201
    return classes.cells(dirty_orders(spark, d), PAIR).groupBy("vc", "v").agg(F.count("*").alias("n"))


@query(f"{SHARED_SQL} SELECT vc, root FROM comp")
def merge_by_history(spark, d):  # noqa: ANN001, ANN201
    return classes.class_of(classes.cells(dirty_orders(spark, d), PAIR))


@query(f"{SHARED_SQL} SELECT kid, count(*) AS n_causes, min(vc) AS least FROM cell GROUP BY kid HAVING count(*) > 1")
def merge_by_tuple(spark, d):  # noqa: ANN001, ANN201
    return classes.cells(dirty_orders(spark, d), PAIR).groupBy("kid").agg(F.count("*").alias("n_causes"), F.min("vc").alias("least")).where("n_causes > 1")


@query(f"{SHARED_SQL} SELECT root, v, CAST(n AS BIGINT) AS n FROM n")
def subgraph_merge(spark, d):  # noqa: ANN001, ANN201
    c = classes.cut(classes.cells(dirty_orders(spark, d), PAIR))
    return classes.class_counts(classes.class_cells(c, classes.class_of(c)))


@query(f"{SHARED_SQL} SELECT root, kid, v FROM dc")
def overlap_dedup(spark, d):  # noqa: ANN001, ANN201
    c = classes.cut(classes.cells(dirty_orders(spark, d), PAIR))
    return classes.class_cells(c, classes.class_of(c))


@query(f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql([RULES[1]])} SELECT vc, root FROM comp")
def subgraph_split(spark, d):  # noqa: ANN001, ANN201
    return classes.class_of(classes.cells(dirty_orders(spark, d), dynamics.without(PAIR, 0)))


@query(f"{SHARED_SQL} {SHARED_FIX}")
def rw_dr(spark, d):  # noqa: ANN001, ANN201
    return classes.repair_shared(dirty_orders(spark, d), PAIR)


def arrival_sql(rules: list[Rule]) -> str:
    """Each tuple by the classes as they stand when it comes: cell (with the birth of its cause), link, reach (causes of a violating tuple's class), n (counts of values there)."""
    m = " UNION ALL ".join(f"SELECT {r.rid} AS rid, {r.lhs} AS l, kid, tid, {r.rhs} AS v FROM dirty WHERE {cond(r)}" for r in rules)
    return f"""m AS ({m}), first AS (SELECT rid, l, v, min(tid) AS t FROM m GROUP BY rid, l, v),
 second AS (SELECT rid, l, t, row_number() OVER (PARTITION BY rid, l ORDER BY t) AS k FROM first),
 cell AS (SELECT m.rid || ':' || m.l AS vc, kid, tid, v, t AS born FROM m JOIN second ON m.rid = second.rid AND m.l = second.l AND k = 2),
 link AS (SELECT a.vc AS x, b.vc AS y, min(greatest(a.tid, a.born, b.born)) AS w FROM cell a JOIN cell b ON a.kid = b.kid AND a.vc <> b.vc GROUP BY ALL),
 asks AS (SELECT kid, tid, v, min(vc) AS vc, bool_or(tid = born) AS is_new FROM cell WHERE tid >= born GROUP BY ALL),
 reach(tid, vc) AS (SELECT tid, vc FROM asks UNION SELECT reach.tid, link.y FROM reach JOIN link ON reach.vc = link.x AND link.w <= reach.tid),
 seen AS (SELECT DISTINCT reach.tid, cell.kid, cell.v FROM reach JOIN cell ON reach.vc = cell.vc AND cell.tid <= reach.tid AND cell.born <= reach.tid),
 n AS (SELECT tid, v, count(*) AS n FROM seen GROUP BY tid, v), best AS (SELECT tid, min({{'a': -n, 'v': v}}) AS m FROM n GROUP BY tid)"""


ARRIVAL_SQL = f"""WITH RECURSIVE {DIRTY_SQL}, {arrival_sql(PAIR)}
 SELECT dirty.kid, dirty.tid, asks.tid IS NOT NULL AS violating, coalesce(is_new, false) AS is_new, CASE WHEN n.n = -m.a THEN n.v ELSE m.v END AS fix
 FROM dirty LEFT JOIN asks ON dirty.tid = asks.tid LEFT JOIN n ON asks.tid = n.tid AND asks.v = n.v LEFT JOIN best ON asks.tid = best.tid"""


@query(ARRIVAL_SQL)
def rw_basic(spark, d):  # noqa: ANN001, ANN201
    return arrival.repair_shared_arrival(dirty_orders(spark, d), PAIR)


def window_classes_sql(rules: list[Rule], mode: str) -> str:
    """Classes of every window w as they stand at the end of pane w: cell, comp, dc, n, best."""
    out = []
    for r in rules:
        i = r.rid
        out.append(f"""b{i} AS (SELECT kid, {r.lhs} AS l, {r.rhs} AS v, CAST(floor((tid - 1) / {STEP}) AS BIGINT) + 1 AS p FROM dirty WHERE {cond(r)}),
 two{i} AS (SELECT l, p FROM (SELECT l, p, v FROM b{i} UNION ALL SELECT l, p + 1, v FROM b{i}) z GROUP BY l, p HAVING min(v) <> max(v))""")
        if mode == "basic":
            out.append(f"life{i} AS (SELECT l, p AS w, p - 1 AS f, true AS bad FROM two{i})")
        else:
            out.append(f"""vio{i} AS (SELECT DISTINCT b{i}.l, b{i}.p FROM b{i} JOIN two{i} ON b{i}.l = two{i}.l AND b{i}.p = two{i}.p),
 isl{i} AS (SELECT l, p, p - row_number() OVER (PARTITION BY l ORDER BY p) AS g FROM vio{i}),
 ep{i} AS (SELECT l, p, min(p) OVER (PARTITION BY l, g) AS birth FROM isl{i}),
 life{i} AS (SELECT l, p AS w, birth - 1 AS f, true AS bad FROM ep{i} UNION ALL SELECT l, max(p) + 1, birth - 1, false FROM ep{i} GROUP BY l, birth)""")
    cells = " UNION ALL ".join(f"SELECT w, w || ':{r.rid}:' || b{r.rid}.l AS vc, kid, v, bad AND p = w AS mine FROM b{r.rid} JOIN life{r.rid} ON b{r.rid}.l = life{r.rid}.l AND p BETWEEN f AND w" for r in rules)
    return f"""{", ".join(out)}, cell AS ({cells}),
 e AS (SELECT DISTINCT a.vc AS x, b.vc AS y FROM cell a JOIN cell b ON a.kid = b.kid AND a.w = b.w),
 cc(x, root) AS (SELECT DISTINCT vc, vc FROM cell UNION SELECT e.y, cc.root FROM cc JOIN e ON cc.x = e.x),
 comp AS (SELECT x AS vc, min(root) AS root FROM cc GROUP BY x),
 dc AS (SELECT root, kid, v, bool_or(mine) AS mine FROM cell JOIN comp ON cell.vc = comp.vc GROUP BY root, kid, v),
 n AS (SELECT root, v, count(*) AS n FROM dc GROUP BY root, v),
 best AS (SELECT root, min({{'a': -n, 'v': v}}) AS m FROM n GROUP BY root)"""


@query(f"WITH RECURSIVE {DIRTY_SQL}, {window_classes_sql(PAIR, 'basic')} {SHARED_FIX} WHERE mine")
def rw_win_basic(spark, d):  # noqa: ANN001, ANN201
    return classes.repair_shared_windows(dirty_orders(spark, d), PAIR, "basic", STEP)


@query(f"WITH RECURSIVE {DIRTY_SQL}, {window_classes_sql(PAIR, 'cumulative')} {SHARED_FIX} WHERE mine")
def rw_win_cumulative(spark, d):  # noqa: ANN001, ANN201
    return classes.repair_shared_windows(dirty_orders(spark, d), PAIR, "cumulative", STEP)


@query(f"{SHARED_SQL}, z AS (SELECT root, count(*) AS k FROM comp GROUP BY root) SELECT CAST(sum(k) AS BIGINT) AS n_causes, count(*) AS n_classes, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_never_merged FROM z")
def violation_graph_stats(spark, d):  # noqa: ANN001, ANN201
    return classes.graph_stats(dirty_orders(spark, d), PAIR)


# Repair


BAD_SQL = f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, bad AS (SELECT l FROM s GROUP BY l HAVING min(r) <> max(r)), n AS (SELECT l, r, CAST(count(*) AS BIGINT) AS n FROM s WHERE l IN (SELECT l FROM bad) GROUP BY l, r)"


@query(f"{BAD_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, r) AS rank FROM n) SELECT l, r, n, rank FROM k WHERE rank <= {TOP}")
def topk_candidates(spark, d):  # noqa: ANN001, ANN201
    return repair.candidates(dirty_orders(spark, d), RULES[6], TOP)


@query(f"{BAD_SQL} SELECT tid % {WORKERS} AS worker, l, r, CAST(count(*) AS BIGINT) AS n FROM s WHERE l IN (SELECT l FROM bad) GROUP BY ALL")
def repair_proposal_partial(spark, d):  # noqa: ANN001, ANN201
    return repair.proposals(dirty_orders(spark, d), RULES[6], WORKERS)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return repair.merged_proposals(repair.proposals(dirty_orders(spark, d), RULES[6], WORKERS))


@query(f"{BAD_SQL} SELECT l, r, n FROM n")
def repair_proposal_merge(spark, d):  # noqa: ANN001, ANN201
    return _merged(spark, d)


def _ranked(r: Rule) -> str:
    i = r.rid
    return f"""{s_sql(r, f"s{i}")}, n{i} AS (SELECT l, r, count(*) AS n, count(*) OVER (PARTITION BY l) AS k FROM s{i} GROUP BY l, r),
 k{i} AS (SELECT l, r, n FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, r) AS rank FROM n{i} WHERE k > 1) z WHERE rank <= {TOP})"""


@query(f"""WITH {DIRTY_SQL}, {", ".join(map(_ranked, PAIR))}, z AS ({" UNION ALL ".join(f"SELECT s{r.rid}.kid, '{r.rhs}' AS attr, k{r.rid}.r AS value, n FROM s{r.rid} JOIN k{r.rid} ON s{r.rid}.l = k{r.rid}.l" for r in PAIR)})
 SELECT kid, attr, value, CAST(sum(n) AS BIGINT) AS n FROM z GROUP BY ALL""")
def aggregate_proposals(spark, d):  # noqa: ANN001, ANN201
    return repair.tuple_proposals(dirty_orders(spark, d), PAIR, TOP)


@query(f"{BAD_SQL}, m AS (SELECT l, min({{'a': -n, 'v': r}}) AS m FROM n GROUP BY l) SELECT l, -m.a AS n, m.v AS v FROM m")
def repair_decide(spark, d):  # noqa: ANN001, ANN201
    return repair.decisions(_merged(spark, d))


@query(f"{BAD_SQL} SELECT s.kid, CAST(count(*) AS BIGINT) AS n_values FROM s JOIN n ON s.l = n.l GROUP BY s.kid")
def proposal_join(spark, d):  # noqa: ANN001, ANN201
    rows = detect.members(dirty_orders(spark, d), RULES[6]).select("kid", "l")
    return rows.join(_merged(spark, d), "l").groupBy("kid").agg(F.count("*").alias("n_values"))


@query(f"{REPAIRED_SQL} SELECT dirty.kid, coalesce(fix, cname) AS cname, violating AS repaired, coalesce(fix <> cname, false) AS changed FROM dirty JOIN fixed ON dirty.kid = fixed.kid")
def repair_apply(spark, d):  # noqa: ANN001, ANN201
    df = dirty_orders(spark, d)
    return repair.apply(df, repair.repair_rule(df, RULES[6]), "cname").select("kid", "cname", "repaired", "changed")


@query(f"""WITH RECURSIVE {DIRTY_SQL}, {classes_sql(PAIR)}, fx AS ({SHARED_FIX}), {s_sql(RULES[6])}, {NONE_SQL}
 SELECT dirty.kid, coalesce(fx.fix, segment) AS segment, coalesce(fixed.fix, cname) AS cname, fx.fix IS NOT NULL OR fixed.fix IS NOT NULL AS repaired FROM dirty LEFT JOIN fx ON dirty.kid = fx.kid LEFT JOIN fixed ON dirty.kid = fixed.kid""")
def output_join(spark, d):  # noqa: ANN001, ANN201
    return Cleaner([*PAIR, RULES[6]]).repair(dirty_orders(spark, d)).select("kid", "segment", "cname", "repaired")


# Rules that come and go


ADDED = dynamics.apply_control([], [(CUT, "dw_add_rule", "9;FD,custkey,segment"), (CUT, "add_rule", "9;FD,custkey,segment")])[0]
DROPPED = dynamics.apply_control([parse_rule(0, "FD,custkey,segment")], [(CUT, "del_rule", "0"), (CUT, "rw_del_rule", "0")])[0]


@query(_detected(ADDED))
def ctl_add_rule(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), ADDED).select(_VIOLATION)


@query(f"WITH {DIRTY_SQL}, {s_sql(ADDED)} SELECT l, count(DISTINCT r) AS n_values, count(*) AS n_cells FROM s GROUP BY l")
def ctl_dw_add_rule(spark, d):  # noqa: ANN001, ANN201
    return detect.cell_groups(dirty_orders(spark, d), ADDED).drop("p", "is_unique")


@query(_detected(DROPPED))
def ctl_del_rule(spark, d):  # noqa: ANN001, ANN201
    return detect.detect(dirty_orders(spark, d), DROPPED).select(_VIOLATION)


@query(f"WITH RECURSIVE {DIRTY_SQL}, {classes_sql([RULES[1]])} {SHARED_FIX}")
def ctl_rw_del_rule(spark, d):  # noqa: ANN001, ANN201
    return classes.repair_shared(dirty_orders(spark, d), dynamics.without(PAIR, 0))


# Streams: the same tuples through keyed state


def _streamed(spark: SparkSession, d: str, cleaner: Cleaner) -> DataFrame:
    import uuid

    from ..streaming.run import drain

    df = dirty_orders(spark, d)
    return drain(spark, df, cleaner, f"stream_{uuid.uuid4().hex}")


@query(f"{REPAIRED_SQL} SELECT kid, tid, violating, fix FROM fixed")
def stream_repair(spark, d):  # noqa: ANN001, ANN201
    return _streamed(spark, d, Cleaner([RULES[6]])).select("kid", "tid", "violating", "fix")


@query(f"WITH {DIRTY_SQL}, {s_sql(RULES[6])}, {pane_sql(STEP)}, {CUMULATIVE_SQL} SELECT kid, tid, violating, fix FROM fixed")
def stream_repair_cumulative(spark, d):  # noqa: ANN001, ANN201
    return _streamed(spark, d, Cleaner([RULES[6]], "cumulative", STEP)).select("kid", "tid", "violating", "fix")


def _live(spark: SparkSession, d: str, rules: list[Rule], cuts: list[int], messages: dict | None = None):  # noqa: ANN202
    import uuid

    from ..functions.shared import shared_dir
    from ..streaming.run import drain_live

    own = Cleaner(rules).live(spark, f"{shared_dir(spark)}/live_{uuid.uuid4().hex}")
    drain_live(spark, dirty_orders(spark, d), own, cuts, messages)
    return own


@query(ARRIVAL_SQL)
def stream_shared(spark, d):  # noqa: ANN001, ANN201
    return _streamed(spark, d, Cleaner(PAIR)).select("kid", "tid", "violating", "is_new", "fix")


@query(f"{REPAIRED_SQL} SELECT dirty.kid, dirty.tid, custkey, loc, segment, coalesce(fix, cname) AS cname, status, violating AS repaired, coalesce(fix <> cname, false) AS changed FROM dirty JOIN fixed ON dirty.kid = fixed.kid")
def stream_tuples(spark, d):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{_live(spark, d, [RULES[6]], [CUT, 2 * CUT]).place}/tuples").drop("batch")


def _sides(*parts: tuple[str, Rule]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (WITH {s_sql(r)}, {NONE_SQL} SELECT kid, tid, '{attr}' AS attr, violating, fix FROM fixed) z" for attr, r in parts)


@query(f"WITH {DIRTY_SQL} {_sides(('cname', replace(RULES[6], to_tid=CUT)), ('segment', replace(RULES[0], from_tid=CUT)))}")
def ctl_stream(spark, d):  # noqa: ANN001, ANN201
    messages = {1: [("del_rule", "6"), ("add_rule", "9;FD,custkey,segment"), ("dw_add_rule", "9;FD,custkey,segment")]}
    own = _live(spark, d, [RULES[6]], [CUT], messages)
    return spark.read.parquet(f"{own.place}/decisions").select("kid", "tid", "attr", "violating", "fix")


#: As ARRIVAL_SQL, but what a tuple makes a cause is linked by earlier tuples only after its decision, half a place on.
IMMEDIATE_SQL = ARRIVAL_SQL.replace("min(greatest(a.tid, a.born, b.born)) AS w", "min(greatest(a.tid, a.born, b.born) + CASE WHEN a.tid < greatest(a.born, b.born) THEN 0.5 ELSE 0 END) AS w")


@query(IMMEDIATE_SQL)
def rw_ir(spark, d):  # noqa: ANN001, ANN201
    return arrival.repair_shared_arrival(dirty_orders(spark, d), PAIR, immediate=True)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _queries.items() if s}
