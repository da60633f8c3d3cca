"""Repair on arrival for rules that share a right-hand side: every tuple by the classes as they stand when it comes.

A group of a rule is a cause from the tuple on that brings its second value (its birth). A tuple is a
cell of its causes, and links them. Each tuple counts under the cause of its that is born first, from
the later of its own place and that birth; another cause of its is linked to that one from the later
of its place and the other's birth. So links have a place in the order from which on they hold, and the class of
a cause at a place is what links up to there reach.

Classes that meet become one, and the smaller one (by its number of causes) goes into the larger. One
row for each cause says into which class it went, and where; following these rows is at most log2(causes)
steps, so the way of a cause is a short array. What a class has at the place where it goes is counted
for the larger one from there on, so a cell counts in a few classes, one after another, and in every
class counts only grow: what is left are the running counts of repair on arrival (see repair).

A tuple's links, ways and counts are joins and aggregates. Only the order of merges is worked out row
by row, in the tasks, over the links of a component, at most BOUND of them at once: longer lists of
links lose those that close a cycle in parts, and are then worked on in slices of the order.

Immediate repair decides for a tuple before the earlier tuples of a group that it makes a cause link that
one to others. Places are doubled for it: such links hold from the odd place on that follows the
tuple's own. Only for these tuples, the group's earlier ones whose class is another one until then
count in addition (extra_counts); a group becomes a cause once, so these are no more than cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..functions.shared import cut
from .detect import turning_points
from .graph import components
from .repair import CHUNK, counted, decided, leading

#: Links of one component that a task works on at once.
BOUND = 1 << 18


def shared_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(kid, tid, v, l0, l1, ...) of the tuples that a rule sees; l<i>: the left-hand side of rule i, null where it does not see the tuple."""
    names = [f"l{i}" for i in range(len(rules))]
    lhs = [F.when(r.sees(), r.left()).alias(c) for r, c in zip(rules, names, strict=True)]
    return df.select("kid", "tid", rules[0].right().alias("v"), *lhs).where(F.coalesce(*names).isNotNull())


def births(firsts: DataFrame) -> DataFrame:
    """(rid, l, born, vc) of the groups with two values; firsts: (rid, l, r, tid), tuples, of each value of a group the first one at least."""
    rows = firsts.select(F.struct("rid", "l").alias("l"), F.lit(0).alias("p"), "r", "tid")
    turns = turning_points(rows, False).select("l.rid", "l.l", F.col("t2").alias("born"))
    return turns.withColumn("vc", F.concat_ws(":", "rid", "l"))


def with_births(rows: DataFrame, rules: Sequence[Rule], turns: DataFrame) -> DataFrame:
    """(kid, tid, v, causes) of rows; causes: array of (born, vc), by place of birth; vc: `rid:lhs`. turns: as births gives them."""
    for i, r in enumerate(rules):
        own = turns.where(F.col("rid") == r.rid).select(F.col("l").alias(f"l{i}"), F.struct("born", "vc").alias(f"c{i}"))
        rows = rows.join(own, f"l{i}", "left")
    found = F.array_sort(F.filter(F.array(*[f"c{i}" for i in range(len(rules))]), lambda c: c.isNotNull()))
    return rows.select("kid", "tid", "v", found.alias("causes"))


def with_causes(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """with_births of all rows by themselves."""
    firsts = None
    for i, r in enumerate(rules):
        own = rows.where(F.col(f"l{i}").isNotNull()).select(F.lit(r.rid).alias("rid"), F.col(f"l{i}").alias("l"), F.col("v").alias("r"), "tid")
        firsts = own if firsts is None else firsts.unionByName(own)
    return with_births(rows, rules, births(firsts))


def cause_links(cells: DataFrame, immediate: bool = False) -> DataFrame:
    """(a, b, w): two causes with a tuple in common, and the place from which on they are linked (immediate: in doubled places)."""
    rest = F.explode(F.slice("causes", 2, F.size("causes") - 1)).alias("c")
    pairs = cells.where(F.size("causes") > 1).select("tid", F.col("causes")[0]["vc"].alias("a"), rest)
    at = F.when(F.col("tid") >= F.col("c.born"), 2 * F.col("tid")).otherwise(2 * F.col("c.born") + 1) if immediate else F.greatest("tid", "c.born")
    return pairs.select("a", F.col("c.vc").alias("b"), at.alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def _kruskal(batches: Iterator[pd.DataFrame], merges: bool) -> Iterator[pd.DataFrame]:
    """Links that come by key and w; those that close no cycle, or what goes into what. Names carry the size of their class."""
    key, root, size = None, {}, {}

    def find(x: str) -> str:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for df in batches:
        out = []
        for k, component, a, b, w, size_a, size_b in df.itertuples(index=False, name=None):
            if k != key:
                key, root, size = k, {}, {}
            size.setdefault(a, size_a)
            size.setdefault(b, size_b)
            x, y = find(a), find(b)
            if x != y:
                if (size[x], y) < (size[y], x):
                    x, y = y, x
                root[y] = x
                size[x] += size[y]
                out.append((y, x, w) if merges else (component, a, b, w))
        yield pd.DataFrame(out, columns=["c", "into", "w"] if merges else ["component", "a", "b", "w"])


def _by_component(edges: DataFrame, key, merges: bool) -> DataFrame:  # noqa: ANN001
    """edges: component, a, b, w, size_a, size_b."""
    rows = edges.select(key.alias("key"), "component", "a", "b", "w", "size_a", "size_b").repartition("key").sortWithinPartitions("key", "w", "a", "b")
    kind = edges.schema["component"].dataType.simpleString()
    schema = f"c {kind}, into {kind}, w long" if merges else f"component {kind}, a {kind}, b {kind}, w long"
    return rows.mapInPandas(lambda batches: _kruskal(batches, merges), schema)


def merge_order(links: DataFrame, bound: int = BOUND, sizes: DataFrame | None = None) -> DataFrame:
    """(c, into, w): the class of each cause but one of a component goes into another one at place w. links: a, b, w; sizes: (class, size) where a and b are classes already (others have size 1)."""
    found = components(links).withColumnRenamed("node", "a")
    edges = cut(links.join(found, "a").select("component", "a", "b", "w"))
    one = [F.lit(1).cast("long").alias(x) for x in ("size_a", "size_b")]

    def sized(own: DataFrame) -> DataFrame:
        if sizes is None:
            return own.select("*", *one)
        for x in ("a", "b"):
            own = own.join(sizes.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}")), x, "left").withColumn(f"size_{x}", F.coalesce(f"size_{x}", F.lit(1).cast("long")))
        return own

    while True:  # links that close a cycle in any part of a component are not needed
        found = edges.groupBy("component").agg(F.count("*").alias("n"))
        row = found.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if not row.all or row.most <= bound:
            break
        parts = found.select("component", F.ceil(F.col("n") / bound).alias("parts"))
        some = edges.join(parts, "component").select("*", *one)
        fewer = cut(_by_component(some, F.xxhash64("component", F.pmod(F.xxhash64("a", "b"), "parts")), False))
        if 10 * fewer.count() > 9 * row.all:
            edges = fewer
            break
        edges = fewer
    if not row.all or row.most <= bound:
        return cut(_by_component(sized(edges), F.xxhash64("component"), True))
    # More causes than a task takes: slices of the order, one after another, each over the classes that those before left.
    place = F.row_number().over(Window.partitionBy("component").orderBy("w", "a", "b"))
    edges = cut(edges.withColumn("slice", F.floor((place - 1) / bound)))
    out = None
    for i in range(edges.agg(F.max("slice")).first()[0] + 1):
        own = edges.where(F.col("slice") == i).drop("slice")
        if out is None:
            own = sized(own)
        else:
            nodes = sized(edges.select(F.explode(F.array("a", "b")).alias("a")).distinct().withColumn("b", F.col("a"))).select(F.col("a").alias("c"), F.col("size_a").alias("own"))
            now = nodes.join(ways(out), "c", "left").select("c", "own", F.coalesce(F.element_at("way", -1)["into"], "c").alias("top"))
            now = cut(now.join(now.groupBy("top").agg(F.sum("own").alias("size")), "top"))
            for x in ("a", "b"):
                own = own.join(now.select(F.col("c").alias(x), F.col("top").alias(f"top_{x}"), F.col("size").alias(f"size_{x}")), x).drop(x).withColumnRenamed(f"top_{x}", x)
        got = _by_component(own, F.xxhash64("component"), True)
        out = cut(got if out is None else out.unionByName(got))
    return out


def ways(merges: DataFrame) -> DataFrame:
    """(c, way): all classes that c's goes into, one after another: array of (into, w). Arrays double in length each round."""
    found = cut(merges.select("c", F.array(F.struct("into", "w")).alias("way")))
    while True:
        last = F.element_at("way", -1)["into"]
        longer = found.withColumn("last", last).join(found.select(F.col("c").alias("last"), F.col("way").alias("rest")), "last", "left")
        now = cut(longer.select("c", F.when(F.col("rest").isNull(), F.col("way")).otherwise(F.concat("way", "rest")).alias("way"), F.col("rest").isNotNull().alias("grew")))
        found = now.drop("grew")
        if now.where("grew").isEmpty():
            return found


def class_at(c, way, at):  # noqa: ANN001, ANN201
    """The class of cause c at a place."""
    return F.coalesce(F.try_element_at(F.filter(way, lambda x: x["w"] <= at), F.lit(-1))["into"], c)


def class_events(cells: DataFrame, way: DataFrame, after: int = 0, classes: DataFrame | None = None) -> DataFrame:
    """(class, at, v, n, kid, tid, is_new): what counts in a class from a place on; kid: of the tuple that asks for a decision there, or null. after: only what begins later; classes: (vc, class) of the causes whose class has another name, way being that of classes."""
    first = F.col("causes")[0]
    asks = F.col("tid") >= first["born"]
    if after:
        cells = cells.where(F.greatest("tid", first["born"]) > after)
    own = cells.select("v", first["vc"].alias("c"), F.greatest("tid", first["born"]).alias("at"), F.when(asks, F.col("kid")).alias("kid"), F.when(asks, F.col("tid")).alias("tid"), F.exists("causes", lambda c: c["born"] == F.col("tid")).alias("is_new"), asks.alias("asks"))
    # Tuples from before the birth count together.
    early = own.where("not asks").groupBy("c", "at", "v").agg(F.count("*").alias("n"))
    none = [F.lit(None).cast(cells.schema[x].dataType).alias(x) for x in ("kid", "tid")]
    events = own.where("asks").select("c", "at", "v", F.lit(1).cast("long").alias("n"), "kid", "tid", "is_new").unionByName(early.select("c", "at", "v", "n", *none, F.lit(None).cast("boolean").alias("is_new")))
    if classes is not None:
        events = events.join(classes.select(F.col("vc").alias("c"), "class"), "c", "left").withColumn("c", F.coalesce("class", "c")).drop("class")
    events = cut(events.join(way, "c", "left"))
    own = events.select(class_at(F.col("c"), F.col("way"), F.col("at")).alias("class"), "at", "v", "n", "kid", "tid", "is_new")
    later = events.where("way is not null").select("at", "v", "n", F.explode("way").alias("x")).where("x.w > at")
    later = later.groupBy(F.col("x.into").alias("class"), F.col("x.w").alias("at"), "v").agg(F.sum("n").alias("n"))
    return own.unionByName(later.select("class", "at", "v", "n", *none, F.lit(None).cast("boolean").alias("is_new")))


def extra_counts(cells: DataFrame, way: DataFrame) -> DataFrame:
    """(tid, kid, class, v, extra): for tuples that make a group a cause, how many of its earlier ones count in another class at that place. way: in doubled places."""
    first = F.col("causes")[0]
    older = cells.select("tid", "v", first["vc"].alias("c"), first["born"].alias("from"), F.explode("causes").alias("x")).where("x.born > tid and x.born > from")
    older = older.select(F.col("x.born").alias("at"), "tid", "v", "c").distinct()
    older = older.join(way, "c", "left").select("at", "tid", "v", class_at(F.col("c"), F.col("way"), 2 * F.col("at")).alias("other"))
    new = cells.where(F.exists("causes", lambda c: c["born"] == F.col("tid"))).select(F.col("tid").alias("at"), "kid", first["vc"].alias("c"))
    new = new.join(way, "c", "left").select("at", "kid", class_at(F.col("c"), F.col("way"), 2 * F.col("at")).alias("class"))
    both = older.join(new, "at").where("other <> class")
    return both.groupBy(F.col("at").alias("tid"), "kid", "class", "v").agg(F.count("*").alias("extra"))


def immediate_fixes(cells: DataFrame, way: DataFrame) -> DataFrame:
    """(kid, tid, is_new, fix) of every violating tuple, decided before what is earlier links its new causes. way: in doubled places."""
    doubled = cells.withColumns({"tid": 2 * F.col("tid"), "causes": F.transform("causes", lambda c: F.struct((2 * c["born"]).alias("born"), c["vc"].alias("vc")))})
    extra = cut(extra_counts(cells, way))
    events = class_events(doubled, way).select(F.col("class").alias("l"), "at", F.col("v").alias("r"), "n", "kid", "tid", "is_new", F.lit(0).cast("long").alias("extra"))
    # What a value counts there is asked by a row that counts nothing.
    asked = extra.select(F.col("class").alias("l"), (2 * F.col("tid")).alias("at"), F.col("v").alias("r"), F.lit(0).cast("long").alias("n"), "kid", (2 * F.col("tid")).alias("tid"), F.lit(None).cast("boolean").alias("is_new"), "extra")
    found = counted(events.unionByName(asked), 2 * CHUNK).select("kid", (F.col("tid") / 2).cast("long").alias("tid"), "r", "is_new", "c", "m", "extra")
    own, asked = found.where("is_new is not null"), found.where("is_new is null")
    more = asked.groupBy("tid").agg(F.min(F.struct((-F.col("c") - F.col("extra")).alias("c"), F.col("r").alias("v"))).alias("more"))
    own = own.join(more, "tid", "left").withColumn("m", F.least("m", "more"))
    return own.select("kid", "tid", "is_new", leading().alias("fix"))


def repair_shared_arrival(df: DataFrame, rules: Sequence[Rule], bound: int = BOUND, immediate: bool = False) -> DataFrame:
    """(kid, tid, violating, is_new, fix) of every tuple that one of the rules sees; is_new: it is the first to violate some rule for its group. All rules have one right-hand side; no windows. immediate: decisions come before the links of what a tuple makes a cause."""
    rows = cut(with_causes(shared_rows(df, rules), rules))
    cells = rows.where(F.size("causes") > 0)
    way = ways(merge_order(cause_links(cells, immediate), bound))
    if immediate:
        fixed = immediate_fixes(cells, way)
    else:
        events = class_events(cells, way)
        fixed = decided(events.select(F.col("class").alias("l"), "at", F.col("v").alias("r"), "n", "kid", "tid", "is_new"), CHUNK)
    quiet = rows.where((F.size("causes") == 0) | (F.col("tid") < F.col("causes")[0]["born"]))
    no = F.lit(False)
    return fixed.select("kid", "tid", F.lit(True).alias("violating"), "is_new", "fix").unionByName(quiet.select("kid", "tid", no.alias("violating"), no.alias("is_new"), F.lit(None).cast("string").alias("fix")))
