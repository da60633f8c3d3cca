"""A running cleaner: each micro-batch is repaired by the batch operators over what those before left.

What a rule has to know of earlier tuples are sums by (group, pane, value), which a Ledger keeps; with
a window, those of passed panes leave it. A micro-batch's tuples are repaired on arrival from these sums
and their own order, with the plans of batch repair, so a micro-batch is spread as its groups and panes
are, and whole tuples come out of it.

Rules come and go while a query runs: control messages are a part of its input, and take effect at the
first tuple of the micro-batch that brings them, one place in the order, which is written down (`rules`
of the state). A bad message is written down, too, and changes nothing.

Right-hand sides with several rules have classes (see operators.arrival): the state then holds which
class a cause is in, and what each class counts, as rows. A micro-batch adds the groups that become
causes, whose earlier tuples come from the log of tuples, and merges the classes that its links join. Where a
rule leaves such a side, or a second one comes to a side, its classes are made anew from the log.

Everything is written by micro-batch and overwritten when one runs again, so results are there once.
Tuples have to come in the order of tid from batch to batch: one at or below the last place is a
replay and is dropped; of equal keys within a batch the first stays. `report` counts both, and rows
without a key or a place with them.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConfigError, RuleDefinitionError
from ..functions.order import pane
from ..functions.rules import Rule, parse_rule
from ..functions.shared import cut, remove
from ..operators import arrival, repair
from ..operators.detect import members
from ..operators.dynamics import apply_control
from .ledger import Ledger
from .stateful import OUT

RULES = "rid int, text string, from_tid long, to_tid long"
CLASSES, COUNTS = "attr string, vc string, class string", "attr string, class string, v string, n long"


def live_sums(rows: DataFrame, mode: str, last_pane: int) -> DataFrame:
    """The sums that a window after last_pane may still reach; rows: as a Ledger keeps them."""
    if mode == "none":
        return rows
    recent = rows.where(F.col("p") >= last_pane - 1)
    if mode == "basic":
        return recent
    group = F.concat_ws(":", "rid", "l")
    runs = repair.episodes(repair.violating_panes(rows.select(group.alias("l"), "p", "r")))
    open_runs = runs.groupBy("l", "birth").agg(F.max("p").alias("last")).where(F.col("last") >= last_pane - 1).groupBy("l").agg((F.min("birth") - 1).alias("first"))
    kept = rows.withColumn("g", group).join(open_runs.withColumnRenamed("l", "g"), "g", "left")
    return kept.where(F.col("p") >= F.least(F.lit(last_pane - 1), F.coalesce("first", F.lit(last_pane - 1)))).drop("g", "first")


class LiveCleaner:
    """place: a folder that driver and executors share. It gets `tuples` (whole, repaired, by batch), `decisions` (see streaming.stateful.OUT) and `state`."""

    def __init__(self, spark: SparkSession, rules: Sequence[Rule], place: str, mode: str = "none", step: int | None = None, every: int = 8) -> None:
        if (mode == "none") == bool(step):
            raise ConfigError("a window needs a step, and only a window has one")
        self.spark, self.rules, self.place, self.mode, self.step = spark, list(rules), place, mode, step
        self.ledger = Ledger(spark, f"{place}/state/sums", every)
        self.report: dict[str, float] = {"rows": 0, "replays": 0, "bad_messages": 0}

    # State of earlier batches

    def _state(self, name: str, batch: int, schema: str) -> DataFrame:
        if not batch:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.place}/state/{name}/{batch - 1}")

    def _keep(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.place}/state/{name}/{batch}")
        if batch > 1:
            remove(self.spark, f"{self.place}/state/{name}/{batch - 2}")

    def rules_before(self, batch: int) -> tuple[int, list[Rule]]:
        """(last place, rules with their lives) as earlier batches left them."""
        if not batch:
            return 0, self.rules
        last = self._state("last", batch, "last long").first()[0]
        rows = self._state("rules", batch, RULES).orderBy("rid", "from_tid").collect()  # a row for each rule there ever was
        return last, [replace(parse_rule(r.rid, r.text), from_tid=r.from_tid, to_tid=r.to_tid) for r in rows]

    def controlled(self, rules: list[Rule], place: int, messages: Iterable[tuple[str, str]], columns: Sequence[str]) -> tuple[list[Rule], list[tuple[str, str, str]]]:
        """(rules after messages (name, payload) at a place, bad ones with what is wrong)."""
        bad = []
        for name, payload in messages:
            try:
                after = apply_control(rules, [(place, name, payload or "")])
                for r in after:
                    r.validate(columns)
                rules = after
            except (RuleDefinitionError, ValueError) as e:
                bad.append((name, payload, str(e)))
        return rules, bad

    # One micro-batch

    def process(self, df: DataFrame, batch: int, messages: Iterable[tuple[str, str]] = ()) -> None:
        """df: kid, tid and attributes."""
        began = time.time()
        last, before = self.rules_before(batch)
        came = Observation(f"came-{batch}-{id(self)}")
        # Tuples are kept where a later rule, or a rule that goes, may need them.
        log = f"{self.place}/state/log/batch-{batch}" if self.mode == "none" else None
        rows = cut(df.observe(came, F.count("*").alias("n")).where((F.col("tid") > last) & F.col("kid").isNotNull()), log)
        again = rows.groupBy("kid").agg(F.count("*").alias("n")).where("n > 1").select("kid")
        if not again.isEmpty():
            # Only keys that came twice are put in order; the first of a key stays, the rest are replays.
            again, first = cut(again), Window.partitionBy("kid").orderBy("tid")
            once = rows.join(again, "kid", "left_semi").select(rows.columns).repartition("kid").withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
            rows = cut(rows.join(again, "kid", "left_anti").select(rows.columns).unionByName(once))
            if log:
                rows = cut(rows, log)
        n, place, end = rows.agg(F.count("*"), F.min("tid"), F.max("tid")).first()
        rules, bad = self.controlled(before, place if n else last + 1, messages, df.columns)
        end = end if n else last
        living = [r for r in rules if (r.to_tid is None or r.to_tid > last + 1) and n]
        decisions = self._decide(rows, batch, before, rules, living, last, end)
        decisions.write.mode("overwrite").parquet(f"{self.place}/decisions/batch={batch}")
        decisions = self.spark.read.schema(OUT).parquet(f"{self.place}/decisions/batch={batch}")
        whole = self.whole(rows, decisions, list(dict.fromkeys(r.rhs for r in rules)))
        out = Observation(f"tuples-{batch}-{id(self)}")
        whole.observe(out, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.place}/tuples/batch={batch}")
        if out.get["n"] != n:
            raise ConfigError(f"batch {batch}: {n} tuples came, {out.get['n']} left")  # never: each has a key of its own
        self._keep("rules", batch, self.spark.createDataFrame([(r.rid, r.text, r.from_tid, r.to_tid) for r in rules], RULES).coalesce(1))
        self._keep("last", batch, self.spark.createDataFrame([(int(end),)], "last long").coalesce(1))
        if bad:
            self.spark.createDataFrame(bad, "name string, payload string, error string").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/bad_messages/batch={batch}")
        self.report["rows"] += n
        self.report["replays"] += came.get["n"] - n
        self.report["bad_messages"] += len(bad)
        self.report["seconds"] = self.report.get("seconds", 0.0) + time.time() - began

    def _history(self, batch: int, schema) -> DataFrame:  # noqa: ANN001
        """All tuples of earlier batches."""
        if not batch:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.place}/state/log/batch-{i}" for i in range(batch)])

    def _decide(self, rows: DataFrame, batch: int, before: list[Rule], rules: list[Rule], living: list[Rule], last: int, end: int) -> DataFrame:
        by: dict[str, list[Rule]] = {}
        for r in living:
            by.setdefault(r.rhs, []).append(r)
        sums = self.ledger.before(batch, lambda x: live_sums(x, self.mode, self._pane(last)))
        if batch:
            sums = cut(sums)
        out, classes, counts, added = None, None, None, None
        for attr, own in by.items():
            if len(own) == 1:
                past = sums.where(F.col("rid") == own[0].rid) if batch else None
                one = repair.repair_rule(rows, own[0], self.mode, self.step, past).drop("r")
            elif self.mode != "none":
                raise ConfigError("with a window, rules that share a right-hand side run by streaming.stateful")
            else:
                one, a, b = self._shared(rows, attr, own, batch, before, sums, last)
                classes, counts = (a, b) if classes is None else (classes.unionByName(a), counts.unionByName(b))
            one = one.select("kid", "tid", F.lit(attr).alias("attr"), "violating", "is_new", "fix")
            out = one if out is None else out.unionByName(one)
            for r in own:
                m = members(rows, r, self.step).select(F.lit(r.rid).alias("rid"), "l", "p", "r", "tid")
                added = m if added is None else added.unionByName(m)
        self.ledger.add(batch, added if added is not None else self.spark.createDataFrame([], "rid int, l string, p long, r string, tid long"))
        if self.mode == "none":
            self._keep("classes", batch, classes if classes is not None else self.spark.createDataFrame([], CLASSES))
            self._keep("counts", batch, counts if counts is not None else self.spark.createDataFrame([], COUNTS))
        return out if out is not None else self.spark.createDataFrame([], OUT)

    def _pane(self, tid: int) -> int:
        return (tid - 1) // self.step + 1 if self.step and tid else 0

    def whole(self, rows: DataFrame, decisions: DataFrame, attrs: Sequence[str]) -> DataFrame:
        """Tuples with repaired values, and repaired and changed, which replace columns of these names."""
        names = [f"__fix_{i}" for i in range(len(attrs))]
        columns = [c for c in rows.columns if c not in ("repaired", "changed")]
        if not attrs:
            return rows.select(*columns, F.lit(False).alias("repaired"), F.lit(False).alias("changed"))
        wide = decisions.where("violating").groupBy("kid").agg(*[F.max(F.when(F.col("attr") == a, F.col("fix"))).alias(c) for a, c in zip(attrs, names, strict=True)])
        out = rows.join(wide, "kid", "left")
        new = {a: F.coalesce(F.col(c), F.col(a).cast("string")) for a, c in zip(attrs, names, strict=True)}
        changed = [F.coalesce(F.col(c) != F.coalesce(F.col(a).cast("string"), F.lit("")), F.lit(False)) for a, c in zip(attrs, names, strict=True)]
        any_changed = changed[0]
        for c in changed[1:]:
            any_changed = any_changed | c
        return out.select(*[new[c].alias(c) if c in new else c for c in columns], F.coalesce(*names).isNotNull().alias("repaired"), any_changed.alias("changed"))

    # Right-hand sides of several rules

    def _shared(self, rows: DataFrame, attr: str, own: list[Rule], batch: int, before: list[Rule], sums: DataFrame, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(decisions, classes, counts) of one right-hand side. classes: (attr, vc, class); counts: (attr, class, v, n)."""
        known = sorted(r.rid for r in before if r.rhs == attr and (r.to_tid is None or r.to_tid > last))
        log = self._history(batch, rows.schema)
        if known == sorted(r.rid for r in own) or not batch:
            classes = self._state("classes", batch, CLASSES).where(F.col("attr") == attr).drop("attr")
            counts = self._state("counts", batch, COUNTS).where(F.col("attr") == attr).drop("attr")
        else:
            classes, counts = self._anew(log, own)
        now = arrival.shared_rows(rows, own)
        # Groups with their births: from sums of the past and tuples of now.
        firsts = sums.where(F.col("rid").isin([r.rid for r in own])).select("rid", "l", "r", F.col("t").alias("tid"))
        for i, r in enumerate(own):
            firsts = firsts.unionByName(now.where(F.col(f"l{i}").isNotNull()).groupBy(F.lit(r.rid).alias("rid"), F.col(f"l{i}").alias("l"), F.col("v").alias("r")).agg(F.min("tid").alias("tid")))
        turns = cut(arrival.births(firsts))
        fresh = turns.where(F.col("born") > last)
        # Earlier tuples of groups that are causes from now on.
        old = arrival.shared_rows(log, own)
        hit = None
        for i, r in enumerate(own):
            mine = old.join(fresh.where(F.col("rid") == r.rid).select(F.col("l").alias(f"l{i}")), f"l{i}", "left_semi").select(*old.columns)
            hit = mine if hit is None else hit.unionByName(mine)
        found = cut(arrival.with_births(now.unionByName(hit.dropDuplicates(["kid"])), own, turns))
        cells = found.where(F.size("causes") > 0)
        sizes = classes.groupBy("class").agg(F.count("*").alias("size"))
        links = arrival.cause_links(cells).where(F.col("w") > last)
        for x in ("a", "b"):
            links = links.join(classes.select(F.col("vc").alias(x), F.col("class").alias("to")), x, "left").withColumn(x, F.coalesce("to", x)).drop("to")
        links = links.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))
        way = arrival.ways(arrival.merge_order(cut(links), sizes=sizes))
        events = arrival.class_events(cells, way, last, classes)
        # What touched classes counted before.
        touched = cut(events.select("class").union(way.select("c")).distinct())
        base = cut(counts.join(touched, "class", "left_semi"))
        moved = base.join(way.withColumnRenamed("c", "class"), "class").select(F.explode("way").alias("x"), "v", "n").select(F.col("x.into").alias("class"), F.col("x.w").alias("at"), "v", "n")
        nobody = [F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in ("kid", "tid")] + [F.lit(None).cast("boolean").alias("is_new")]
        all_events = cut(events.unionByName(base.select("class", F.lit(last).alias("at"), "v", "n", *nobody)).unionByName(moved.select("class", "at", "v", "n", *nobody)))
        fixed = repair.decided(all_events.select(F.col("class").alias("l"), "at", F.col("v").alias("r"), "n", "kid", "tid", "is_new"))
        no = F.lit(False)
        quiet = found.where(F.col("tid") > last).where((F.size("causes") == 0) | (F.col("tid") < F.col("causes")[0]["born"]))
        decisions = fixed.select("kid", "tid", F.lit(True).alias("violating"), "is_new", "fix").unionByName(quiet.select("kid", "tid", no.alias("violating"), no.alias("is_new"), F.lit(None).cast("string").alias("fix")))
        # What the next batch starts from.
        vcs = classes.unionByName(fresh.select("vc", F.col("vc").alias("class")))
        top = F.coalesce(F.try_element_at("way", F.lit(-1))["into"], F.col("class"))
        classes = cut(vcs.join(way.withColumnRenamed("c", "class"), "class", "left").select(F.lit(attr).alias("attr"), "vc", top.alias("class")))
        gone = way.select(F.col("c").alias("class"))
        new = all_events.join(gone, "class", "left_anti").groupBy("class", "v").agg(F.sum("n").alias("n"))
        counts = cut(counts.join(touched, "class", "left_anti").select("class", "v", "n").unionByName(new).select(F.lit(attr).alias("attr"), "class", "v", "n"))
        return decisions, classes, counts

    def _anew(self, log: DataFrame, own: list[Rule]) -> tuple[DataFrame, DataFrame]:
        """(classes, counts) of all tuples so far for these rules alone."""
        cells = cut(arrival.with_causes(arrival.shared_rows(log, own), own).where(F.size("causes") > 0))
        from ..operators.graph import components

        found = components(arrival.cause_links(cells).select("a", "b")).withColumnsRenamed({"node": "vc", "component": "class"})
        vcs = cells.select(F.explode("causes").alias("c")).select("c.vc").distinct()
        classes = cut(vcs.join(found, "vc", "left").select("vc", F.coalesce("class", "vc").alias("class")))
        first = cells.select(F.col("causes")[0]["vc"].alias("vc"), "v")
        return classes, cut(first.join(classes, "vc").groupBy("class", "v").agg(F.count("*").alias("n")))

    # The query

    def start(self, tuples: DataFrame, control: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
        """Run over a stream of tuples (kid, tid, attributes) and one of control messages (name, payload)."""
        columns = tuples.columns
        both = tuples.select(F.struct(*columns).alias("tuple"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("payload"))
        if control is not None:
            both = both.unionByName(control.select(F.lit(None).cast(both.schema["tuple"].dataType).alias("tuple"), "name", "payload"))

        def run(df: DataFrame, batch: int) -> None:
            # Messages are few; of one batch, drops come before additions of the same rule, so that a rule can be replaced.
            messages = [(r.name, r.payload) for r in df.where("name is not null").select("name", "payload").orderBy(F.desc("name"), "payload").collect()]
            self.process(df.where("tuple is not null").select("tuple.*"), batch, messages)

        writer = both.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.place}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
