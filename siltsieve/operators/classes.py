"""Equivalence classes for rules that share a right-hand side, as they stand at the end.

A violation cause is (rule, left-hand side) of a group with two values or more. Causes with a tuple
in common are of one class; a class's cells are distinct tuples, and each gets the most frequent
value. Each tuple links its causes to the smallest of them, so links are as many as cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import pane
from ..functions.rules import Rule
from ..functions.shared import cut
from .detect import members
from .graph import components
from .repair import episodes


def cells(df: DataFrame, rules: Sequence[Rule], panes: tuple[int, int] | None = None, step: int | None = None) -> DataFrame:
    """(kid, tid, vc, v) of the cells of violating groups; vc: `rid:lhs`. panes: the first and last pane that is live."""
    out = None
    for r in rules:
        rows = members(df, r, step)
        if panes:
            rows = rows.where(F.col("p").between(*panes))
        bad = rows.groupBy("l").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a <> b").select("l")
        one = rows.join(bad, "l", "left_semi").select("kid", "tid", F.concat(F.lit(f"{r.rid}:"), "l").alias("vc"), F.col("r").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def class_of(cells: DataFrame) -> DataFrame:
    """(vc, root): the class of each cause, by its smallest cause."""
    least = cells.groupBy("kid").agg(F.min("vc").alias("b"), F.max("vc").alias("most")).where("b <> most").select("kid", "b")
    links = cells.join(least, "kid").select(F.col("vc").alias("a"), "b")
    found = components(links)
    return cells.select("vc").distinct().join(found.withColumnRenamed("node", "vc"), "vc", "left").select("vc", F.coalesce("component", "vc").alias("root"))


def class_cells(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, kid, v): distinct cells of each class; a cell under several causes counts once."""
    return cells.join(roots, "vc").select("root", "kid", "v").distinct()


def class_counts(distinct_cells: DataFrame) -> DataFrame:
    return distinct_cells.groupBy("root", "v").agg(F.count("*").alias("n"))


def repair_shared(df: DataFrame, rules: Sequence[Rule], panes: tuple[int, int] | None = None, step: int | None = None) -> DataFrame:
    """(kid, fix) of every cell in a class."""
    own = cut(cells(df, rules, panes, step))
    dc = class_cells(own, class_of(own))
    n = class_counts(dc)
    best = n.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("c"), F.col("v").alias("v"))).alias("m"))
    return dc.join(n, ["root", "v"]).join(best, "root").select("kid", F.when(F.col("n") == -F.col("m.c"), F.col("v")).otherwise(F.col("m.v")).alias("fix"))


def window_lives(seen: DataFrame, mode: str) -> DataFrame:
    """(l, first, birth, last, end): runs of windows in which a group is a cause. seen: distinct l, p, v.

    Its cells are those of the panes from first on; it violates in windows birth to last, and links its
    cells up to window end. In basic mode each violating window is a run, of a pane and the one before.
    In cumulative mode cells are kept, from the pane before the first of consecutive violating panes on,
    and the group counts for one window more, as a link.
    """
    both = seen.unionByName(seen.withColumn("p", F.col("p") + 1))
    two = both.groupBy("l", "p").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("l", "p")
    if mode == "basic":
        return two.select("l", (F.col("p") - 1).alias("first"), F.col("p").alias("birth"), F.col("p").alias("last"), F.col("p").alias("end"))
    runs = episodes(two.join(seen.select("l", "p").distinct(), ["l", "p"])).groupBy("l", "birth").agg(F.max("p").alias("last"))
    return runs.select("l", (F.col("birth") - 1).alias("first"), "birth", "last", (F.col("last") + 1).alias("end"))


def window_cells(df: DataFrame, rules: Sequence[Rule], mode: str, step: int) -> tuple[DataFrame, DataFrame]:
    """(rows, cells). rows: kid and cell; cells: (cell, p, v, n, spans) of each of them that belongs to a cause; spans: array of (f, t, last, vc), the windows f to t in which it is a cell of cause vc (`rid:birth:lhs`), by rule. One row for a cell's whole life; equal tuples of a pane are one cell, n of them."""
    names = [f"l{i}" for i in range(len(rules))]
    lhs = [F.when(r.sees(), r.left()).alias(c) for r, c in zip(rules, names, strict=True)]
    rows = df.select("kid", pane(step).alias("p"), rules[0].right().alias("v"), *lhs).where(F.coalesce(*names).isNotNull())
    rows = rows.withColumn("cell", F.to_json(F.struct("p", "v", *names)))
    cells = cut(rows.groupBy("cell", "p", "v", *names).agg(F.count("*").alias("n")))
    found = cells
    for r, name in zip(rules, names, strict=True):
        lives = window_lives(cells.where(F.col(name).isNotNull()).select(F.col(name).alias("l"), "p", "v").distinct(), mode)
        span = F.struct("birth", F.col("end").alias("t"), "last", F.concat_ws(":", F.lit(r.rid), "birth", "l").alias("vc"))
        # By pane, so that a group's cells meet only the runs that they are in.
        by_pane = lives.select("l", F.explode(F.sequence("first", "end")).alias("p"), span.alias("s")).groupBy(F.col("l").alias(name), "p").agg(F.array_sort(F.collect_list("s")).alias(f"s{name}"))
        found = found.join(by_pane, [name, "p"], "left")
    spans = F.flatten(F.array(*[F.coalesce(f"s{name}", F.array()) for name in names]))
    live = F.transform(spans, lambda s: F.struct(F.greatest(s["birth"], F.col("p")).alias("f"), s["t"].alias("t"), s["last"].alias("last"), s["vc"].alias("vc")))
    return rows.select("kid", "cell"), cut(found.select("cell", "p", "v", "n", live.alias("spans")).where(F.size("spans") > 0))


def window_changes(cells: DataFrame) -> DataFrame:
    """(vc, v, w, n): by how much the count of a value changes at a window for a cause. A cell counts for the first of its causes that is there, so for one at a time."""
    ends = F.array_sort(F.array_distinct(F.concat(F.transform("spans", lambda s: s["f"]), F.transform("spans", lambda s: s["t"] + 1))))
    own = lambda at: F.try_element_at(F.filter("spans", lambda s: (s["f"] <= at) & (at <= s["t"])), F.lit(1))["vc"]
    rows = cells.withColumn("ends", ends)
    pieces = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct(F.element_at("ends", i).alias("f"), F.element_at("ends", i + 1).alias("t"), own(F.element_at("ends", i)).alias("vc")))
    rows = rows.select("v", "n", F.explode(pieces).alias("x")).where("x.vc is not null")
    both = F.explode(F.array(F.struct(F.col("x.f").alias("w"), F.col("n").alias("n")), F.struct(F.col("x.t").alias("w"), (-F.col("n")).alias("n")))).alias("y")
    return rows.select(F.col("x.vc").alias("vc"), "v", both).groupBy("vc", "v", F.col("y.w").alias("w")).agg(F.sum("y.n").alias("n"))


def window_counts(changes: DataFrame) -> DataFrame:
    """(node, v, n): what a cause counts of a value in each window; node: `window|vc`."""
    last = F.lead("w").over(Window.partitionBy("vc", "v").orderBy("w"))
    so_far = F.sum("n").over(Window.partitionBy("vc", "v").orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = changes.select("vc", "v", "w", last.alias("up_to"), so_far.alias("n")).where("n > 0")
    each = kept.select("vc", "v", "n", F.explode(F.sequence("w", F.col("up_to") - 1)).alias("w"))
    return each.select(F.concat_ws("|", "w", "vc").alias("node"), "v", "n")


def window_links(cells: DataFrame) -> DataFrame:
    """(a, b): nodes of one window that have a cell in common. A pair of causes is linked from its first common cell on, so it is one row until windows are told apart."""
    first = F.transform(F.sequence(F.lit(1), F.size("spans") - 1), lambda i: F.struct(F.element_at("spans", i).alias("a"), F.slice("spans", i + 1, F.size("spans")).alias("rest")))
    rows = cells.where(F.size("spans") > 1).select(F.explode(first).alias("x")).select("x.a", F.explode("x.rest").alias("b"))
    pairs = rows.select(F.col("a.vc").alias("a"), F.col("b.vc").alias("b"), F.greatest("a.f", "b.f").alias("f"), F.least("a.t", "b.t").alias("t")).where("f <= t")
    pairs = pairs.groupBy("a", "b").agg(F.min("f").alias("f"), F.max("t").alias("t"))
    each = pairs.select("a", "b", F.explode(F.sequence("f", "t")).alias("w"))
    return each.select(F.concat_ws("|", "w", "a").alias("a"), F.concat_ws("|", "w", "b").alias("b"))


def repair_shared_windows(df: DataFrame, rules: Sequence[Rule], mode: str, step: int) -> DataFrame:
    """(kid, fix) of every tuple in a violating group, by the classes as they stand at the end of its pane (see window_lives).

    All windows are computed at once. A cell is one row for its life. What is there for each window are
    a cause, its different values and its links to others, of which a group has fewer than cells.
    """
    rows, cells = window_cells(df, rules, mode, step)
    known = components(window_links(cells)).select("node", F.col("component").alias("root"))
    counts = window_counts(window_changes(cells)).join(known, "node", "left").select(F.coalesce("root", "node").alias("root"), "v", "n")
    n = cut(counts.groupBy("root", "v").agg(F.sum("n").alias("of")))
    best = n.groupBy("root").agg(F.min(F.struct((-F.col("of")).alias("c"), F.col("v").alias("v"))).alias("m"))
    bad = F.try_element_at(F.filter("spans", lambda s: (s["f"] == F.col("p")) & (F.col("p") <= s["last"])), F.lit(1))["vc"]
    asks = cells.select("cell", "v", F.concat_ws("|", "p", bad).alias("node"), bad.alias("bad")).where("bad is not null")
    asks = asks.join(known, "node", "left").select("cell", "v", F.coalesce("root", "node").alias("root"))
    fixes = asks.join(n, ["root", "v"]).join(best, "root").select("cell", F.when(F.col("of") == -F.col("m.c"), F.col("v")).otherwise(F.col("m.v")).alias("fix"))
    return rows.join(fixes, "cell").select("kid", "fix")


def graph_stats(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: causes, classes, classes of a single cause."""
    own = cut(cells(df, rules))
    sizes = class_of(own).groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_causes"), F.count("*").alias("n_classes"), F.sum((F.col("n") == 1).cast("long")).alias("n_never_merged"))
