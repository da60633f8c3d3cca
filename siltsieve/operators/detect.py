"""Detection of tuples that violate a rule on arrival.

A tuple violates a rule when its group (equal left-hand sides, earlier tuples of the window and
itself) has two values or more. So all it takes is the place where each value is first seen: from
the second of these on, every tuple of the group violates, and that second one is the new violation.
First places are hash aggregates with partial results in every task, so a hot group is not gathered
for them; tuples then meet their group's place in a join, which Spark broadcasts where the places are
few and whose hot keys adaptive execution splits. With windows the groups are those of (lhs, pane), and values of the pane before count
as seen at 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import pane
from ..functions.rules import Rule, rules_frame


def members(df: DataFrame, rule: Rule, step: int | None = None, tid: str = "tid") -> DataFrame:
    """(kid, tid, l, r, p) of the tuples that a rule sees; p: the pane, 0 without windows. Only the rule's attributes are read."""
    p = pane(step, tid) if step else F.lit(0).cast("long")
    return df.where(rule.sees(tid)).select("kid", F.col(tid).alias("tid"), rule.left().alias("l"), rule.right().alias("r"), p.alias("p"))


def turning_points(rows: DataFrame, windowed: bool) -> DataFrame:
    """(l, p, t2, other) of groups with two values: the place from which on tuples violate, and the value that was there before."""
    first = rows.groupBy("l", "p", "r").agg(F.min("tid").alias("t"))
    if windowed:
        carried = first.select("l", (F.col("p") + 1).alias("p"), "r", F.lit(0).cast("long").alias("t"))
        first = first.unionByName(carried).groupBy("l", "p", "r").agg(F.min("t").alias("t"))
    # One row for each value of a group, not for each tuple.
    w = Window.partitionBy("l", "p").orderBy("t", "r")
    ranked = first.withColumn("k", F.row_number().over(w)).withColumn("other", F.lag("r").over(w))
    return ranked.where("k = 2").select("l", "p", F.col("t").alias("t2"), "other")


def detect(df: DataFrame, rule: Rule, step: int | None = None) -> DataFrame:
    """(kid, tid, rid, l, r, p, is_new) of the tuples that violate a rule; step: half of the window, None for no window."""
    rows = members(df, rule, step)
    turns = turning_points(rows, step is not None)
    out = rows.join(turns, ["l", "p"]).where("tid >= t2")
    return out.select("kid", "tid", F.lit(rule.rid).alias("rid"), "l", "r", "p", (F.col("tid") == F.col("t2")).alias("is_new"))


def detect_all(df: DataFrame, rules: Sequence[Rule], step: int | None = None) -> DataFrame:
    """detect for several rules, with attr (the right-hand side) and coordinate (new, and the rule shares its right-hand side)."""
    shared = {r.rid for r in rules for q in rules if r.rid != q.rid and r.rhs == q.rhs}
    out = None
    for r in rules:
        one = detect(df, r, step).withColumns({"attr": F.lit(r.rhs), "coordinate": F.col("is_new") & F.lit(r.rid in shared)})
        out = one if out is None else out.unionByName(one)
    return out


def other_tuples(df: DataFrame, rule: Rule, step: int | None = None) -> DataFrame:
    """(kid, tid, l, r, othervalue, other_tid): new violations, a row for each tuple with the one value that stood before."""
    rows = members(df, rule, step)
    turns = turning_points(rows, step is not None)
    panes = F.explode(F.array(F.col("p") - 1, F.col("p")) if step else F.array("p")).alias("q")  # so that a group's panes meet only those beside them
    fresh = rows.join(turns, ["l", "p"]).where("tid = t2").select("kid", "tid", "l", "r", F.col("other").alias("othervalue"), panes)
    old = rows.select("l", F.col("p").alias("q"), F.col("tid").alias("other_tid"), F.col("r").alias("othervalue"))
    return fresh.join(old, ["l", "q", "othervalue"]).where(F.col("other_tid") < F.col("tid")).select("kid", "tid", "l", "r", "othervalue", "other_tid")


def new_violations(df: DataFrame, rule: Rule, step: int | None = None) -> DataFrame:
    """(kid, tid, l, r, othervalue, n_other, first_other, last_other): new violations with the one value that stood before, and how many tuples have it; other_tuples has these."""
    own = other_tuples(df, rule, step).groupBy("kid", "tid", "l", "r", "othervalue")
    return own.agg(F.count("*").alias("n_other"), F.min("other_tid").alias("first_other"), F.max("other_tid").alias("last_other"))


def cell_groups(df: DataFrame, rule: Rule, step: int | None = None) -> DataFrame:
    """(l, p, n_values, n_cells, is_unique): a rule's groups, at the end or by pane over the pane and the one before."""
    counts = members(df, rule, step).groupBy("l", "p", "r").agg(F.count("*").alias("n"))
    if step:
        counts = counts.unionByName(counts.withColumn("p", F.col("p") + 1)).groupBy("l", "p", "r").agg(F.sum("n").alias("n"))
    return counts.groupBy("l", "p").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_cells")).withColumn("is_unique", F.col("n_values") == 1)


def violation_groups(violations: DataFrame) -> DataFrame:
    """(kid, tid, attr, rids, coordinate): all violations of a tuple by right-hand side."""
    return violations.groupBy("kid", "tid", "attr").agg(F.array_sort(F.collect_list("rid")).alias("rids"), F.max("coordinate").alias("coordinate"))


def clean(df: DataFrame, violations: DataFrame) -> DataFrame:
    """The tuples of df without any violation."""
    return df.join(violations.select("kid").distinct(), "kid", "left_anti")


def state_stats(df: DataFrame, rule: Rule) -> DataFrame:
    """One row: groups, most values in a group, most tuples in a group."""
    return cell_groups(df, rule).agg(F.count("*").alias("n_groups"), F.max("n_values").alias("max_values"), F.max("n_cells").alias("max_cells"))


def routed(df: DataFrame, rules: Sequence[Rule], workers: int) -> DataFrame:
    """(kid, tid, rid, worker, l, r): the sub-tuple of each rule that sees a tuple; rule i belongs to worker i % workers."""
    out = None
    for r in rules:
        one = members(df, r).select("kid", "tid", F.lit(r.rid).alias("rid"), F.lit(r.rid % workers).alias("worker"), "l", "r")
        out = one if out is None else out.unionByName(one)
    return out


def rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for r in rules:
        r.validate(df.columns)
    return rules_frame(df.sparkSession, rules)
