"""Repair on arrival for rules that share their right-hand side with no other.

A violating tuple gets the most frequent value of its group so far (its own if that is among the
most frequent, else the smallest of them). Counts only grow, so the running maximum of counts is the
current one. Groups are cut into panes (or, without windows, into chunks of the order): what came
before a pane is summed up by (group, pane, value), and running counts are needed within a pane
only. So a hot group is spread over its panes, and no task sorts more than one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.rules import Rule
from ..functions.shared import cut
from .detect import members, turning_points

#: Tuples to a chunk where there is no window.
CHUNK = 1 << 20
MODES = ("none", "basic", "cumulative")


def episodes(violating_panes: DataFrame) -> DataFrame:
    """(l, p, birth): for each violating pane (l, p) the first one of its run of consecutive violating panes."""
    w = Window.partitionBy("l").orderBy("p")
    runs = violating_panes.withColumn("g", F.col("p") - F.row_number().over(w))
    return runs.withColumn("birth", F.min("p").over(Window.partitionBy("l", "g"))).select("l", "p", "birth")


def _reset(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """(l, p, birth) of panes whose values (l, start, p, r) come by run and pane. What is held are a run's values since its last reset."""
    run, pane, birth = None, None, None
    seen: set[str] = set()  # since the pane before birth
    own: set[str] = set()  # of the pane
    for df in batches:
        out = []
        for l, start, p, r in df[["l", "start", "p", "r"]].itertuples(index=False, name=None):
            if (l, start) != run:
                run, pane, birth, seen, own = (l, start), None, start, set(), set()
            if p != pane:
                # A birth's own pane and the one before count in any case.
                if pane is not None and pane >= birth and len(seen) > limit:
                    birth, seen = p, own
                pane, own = p, set()
                if p >= start:
                    out.append((l, p, birth))
            seen.add(r)
            own.add(r)
        yield pd.DataFrame(out, columns=["l", "p", "birth"])


def limited(lives: DataFrame, values: DataFrame, limit: int) -> DataFrame:
    """lives with births moved on where a group has seen too many values: at the first pane that begins with more than limit values since the one before its birth, only that pane and the one before count from there on. values: (l, p, r).

    Each run of violating panes is walked once, in order. More than limit + 1 values of one pane say no
    more than these, so a run comes with at most so many for each pane, however many tuples it has.
    """
    first = F.row_number().over(Window.partitionBy("l", "p").orderBy("r"))
    seen = values.select("l", "p", "r").distinct().withColumn("k", first).where(F.col("k") <= limit + 1)
    runs = lives.unionByName(lives.select("l", (F.col("birth") - 1).alias("p"), "birth").distinct()).withColumnRenamed("birth", "start")
    rows = seen.join(runs, ["l", "p"]).select("l", "start", "p", "r").repartition("l", "start").sortWithinPartitions("l", "start", "p")
    return cut(rows.mapInPandas(lambda batches: _reset(batches, limit), "l string, p long, birth long"))


def _before_growing(counts: DataFrame) -> DataFrame:
    """(l, e, p, r, n, before, lead): what each value counted before the pane, and (-count, value) of the leading value then. counts: l, e, p, r, n."""
    own = Window.partitionBy("l", "e", "r").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.partitionBy("l", "e").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    out = counts.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    return out.withColumn("lead", F.min(F.struct((-(F.col("before") + F.col("n"))).alias("c"), F.col("r").alias("v"))).over(all_before))


def counted(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """events that have a tid, with c, how often their value r of group l came up to their place `at`, and m, (-count, value) of the leading value there. events: l, at, r, n (how often), tid, and further columns; those at a tuple's place count for it."""
    rows = cut(events.withColumns({"e": F.lit(0).cast("long"), "p": F.expr(f"(at - 1) div {chunk}")}))
    base = _before_growing(rows.groupBy("l", "e", "p", "r").agg(F.sum("n").alias("n")))
    order = ["at", F.col("tid").isNotNull()]  # a tuple comes after all else at its place
    own = Window.partitionBy("l", "e", "p", "r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("l", "e", "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_c = rows.join(base.select("l", "e", "p", "r", "before", "lead"), ["l", "e", "p", "r"]).withColumn("c", F.col("before") + F.sum("n").over(own))
    led = with_c.withColumn("m", F.least(F.min(F.struct((-F.col("c")).alias("c"), F.col("r").alias("v"))).over(group), F.col("lead")))
    return led.where("tid is not null").select(*events.columns, "c", "m")


def leading() -> Column:
    """The leading value of m, or r where it leads with it."""
    return F.when(F.col("c") == -F.col("m.c"), F.col("r")).otherwise(F.col("m.v"))


def decided(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """events that have a tid, with fix: the most frequent value r of their group l among all events up to their place `at` (see counted)."""
    return counted(events, chunk).select(*events.columns, leading().alias("fix"))


def _before_basic(counts: DataFrame) -> DataFrame:
    """As _before_growing, with the pane before as the only one that counts."""
    last = counts.select("l", "e", (F.col("p") + 1).alias("p"), "r", F.col("n").alias("before"))
    lead = last.groupBy("l", "e", "p").agg(F.min(F.struct((-F.col("before")).alias("c"), F.col("r").alias("v"))).alias("lead"))
    return counts.join(last, ["l", "e", "p", "r"], "left").withColumn("before", F.coalesce("before", F.lit(0))).join(lead, ["l", "e", "p"], "left")


def repair_rule(df: DataFrame, rule: Rule, mode: str = "none", step: int | None = None, past: DataFrame | None = None, value_limit: int | None = None) -> DataFrame:
    """(kid, tid, r, violating, is_new, fix) of every tuple that the rule sees; fix: null where it does not violate. value_limit: in cumulative mode, see limited.

    past: (l, p, r, n, t), tuples before all of df, n of them from t on with one value in one pane (0
    without windows); of those, what a window may still reach.
    """
    if mode not in MODES:
        raise ConfigError(f"unknown window mode {mode}")
    if (mode == "none") == bool(step):
        raise ConfigError("a window needs a step, and only a window has one")
    # They are read several times below; the order of tuples behind them is computed once.
    rows = members(df, rule, step).withColumn("n", F.lit(1).cast("long"))
    if past is not None:
        groups = rows.select("l").distinct()
        old = past.join(groups, "l", "left_semi").select(F.lit(None).cast(df.schema["kid"].dataType).alias("kid"), F.col("t").alias("tid"), "l", "r", "p", "n")
        rows = rows.unionByName(old)
    rows = cut(rows)
    turns = turning_points(rows, bool(step)).select("l", "p", "t2")
    rows = rows.join(turns, ["l", "p"], "left").withColumn("violating", F.coalesce(F.col("tid") >= F.col("t2"), F.lit(False))).withColumn("is_new", F.coalesce(F.col("tid") == F.col("t2"), F.lit(False))).drop("t2")
    if mode == "none":
        # Groups without two values need no counts.
        rows = rows.withColumn("p", F.expr(f"(tid - 1) div {CHUNK}")).withColumn("e", F.lit(0).cast("long"))
        turned = turns.select("l")
        live, quiet = rows.join(turned, "l", "left_semi"), rows.join(turned, "l", "left_anti")
        base = _before_growing(live.groupBy("l", "e", "p", "r").agg(F.sum("n").alias("n")))
    elif mode == "basic":
        live, quiet = rows.withColumn("e", F.lit(0).cast("long")), None
        base = _before_basic(live.groupBy("l", "e", "p", "r").agg(F.sum("n").alias("n")))
    else:
        # A value that a pane had before may not tell where its tuples stand, so panes are judged by their values.
        lives = episodes(violating_panes(rows))
        if value_limit:
            lives = limited(lives, rows, value_limit)
        with_birth = lives.unionByName(lives.select("l", (F.col("birth") - 1).alias("p"), "birth").distinct()).withColumnRenamed("birth", "e")
        counts = rows.groupBy("l", "p", "r").agg(F.sum("n").alias("n")).join(with_birth, ["l", "p"])
        base = _before_growing(counts.select("l", "e", "p", "r", "n"))
        live, quiet = rows.join(lives.withColumnRenamed("birth", "e"), ["l", "p"]), rows.join(lives, ["l", "p"], "left_anti")
    own = Window.partitionBy("l", "e", "p", "r").orderBy("tid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("l", "e", "p").orderBy("tid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_c = live.join(base.select("l", "e", "p", "r", "before", "lead"), ["l", "e", "p", "r"]).withColumn("c", F.col("before") + F.sum("n").over(own))
    led = with_c.withColumn("m", F.least(F.min(F.struct((-F.col("c")).alias("c"), F.col("r").alias("v"))).over(group), F.col("lead")))
    fix = F.when(F.col("violating"), leading())
    out = led.where("kid is not null" if past is not None else "true").select("kid", "tid", "r", "violating", "is_new", fix.alias("fix"))
    if quiet is None:
        return out
    quiet = quiet.where("kid is not null" if past is not None else "true")
    return out.unionByName(quiet.select("kid", "tid", "r", "violating", "is_new", F.lit(None).cast("string").alias("fix")))


def violating_panes(rows: DataFrame) -> DataFrame:
    """(l, p) of the panes in which a tuple violates: they have tuples, and two values with those of the pane before. rows: l, p, r."""
    seen = rows.select("l", "p", "r").distinct()
    both = seen.select("l", "p", "r", F.lit(1).alias("own")).unionByName(seen.select("l", (F.col("p") + 1).alias("p"), "r", F.lit(0).alias("own")))
    found = both.groupBy("l", "p").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.max("own").alias("own"))
    return found.where("a <> b and own = 1").select("l", "p")


def candidates(df: DataFrame, rule: Rule, k: int) -> DataFrame:
    """(l, r, n, rank) of the k most frequent values of every violating group at the end."""
    counts = members(df, rule).groupBy("l", "r").agg(F.count("*").alias("n"))
    w = Window.partitionBy("l")
    ranked = counts.withColumn("n_values", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "r")))
    return ranked.where((F.col("n_values") > 1) & (F.col("rank") <= k)).select("l", "r", "n", "rank")


def proposals(df: DataFrame, rule: Rule, workers: int) -> DataFrame:
    """(worker, l, r, n): each worker's partial counts of violating groups, cells dealt by tid."""
    rows = members(df, rule)
    bad = rows.groupBy("l").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("l")
    return rows.join(bad, "l", "left_semi").groupBy((F.col("tid") % workers).cast("int").alias("worker"), "l", "r").agg(F.count("*").alias("n"))


def merged_proposals(partial: DataFrame) -> DataFrame:
    """(l, r, n): partial counts of all workers, summed."""
    return partial.groupBy("l", "r").agg(F.sum("n").alias("n"))


def tuple_proposals(df: DataFrame, rules: Sequence[Rule], k: int) -> DataFrame:
    """(kid, attr, value, n): what all rules together propose for a tuple: the k most frequent values of each of its violating groups with their counts, summed up by value."""
    out = None
    for r in rules:
        one = members(df, r).select("kid", "l").join(candidates(df, r, k), "l").select("kid", F.lit(r.rhs).alias("attr"), F.col("r").alias("value"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kid", "attr", "value").agg(F.sum("n").alias("n"))


def decisions(counts: DataFrame) -> DataFrame:
    """(l, n, v): the most frequent value of each group, the smallest of those."""
    best = counts.groupBy("l").agg(F.min(F.struct((-F.col("n")).alias("c"), F.col("r").alias("v"))).alias("m"))
    return best.select("l", (-F.col("m.c")).alias("n"), F.col("m.v").alias("v"))


def apply(df: DataFrame, fixes: DataFrame, attr: str) -> DataFrame:
    """df with attr replaced by fix where there is one, and repaired (it violated), changed (its value is another). fixes: kid, fix."""
    out = df.join(fixes.where("fix is not null").select("kid", "fix"), "kid", "left")
    return out.withColumns({attr: F.coalesce("fix", attr), "repaired": F.col("fix").isNotNull(), "changed": F.coalesce(F.col("fix") != F.coalesce(attr, F.lit("")), F.lit(False))}).drop("fix")
