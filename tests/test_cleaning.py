"""Rules, configuration, golden cases, and closed forms and machines against plain models."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltsieve.errors import ConfigError, OrderError, RuleDefinitionError
from siltsieve.functions.order import with_tid
from siltsieve.functions.rules import Rule, parse_rule
from siltsieve.operators import classes, detect, dynamics, repair
from siltsieve.plans.cleaner import Cleaner
from siltsieve.plans.config import parse_config
from siltsieve.sources import lines
from siltsieve.streaming.machines import ClassMachine, GroupMachine, decide
from siltsieve.streaming.run import drain

RULE = Rule(0, "a", "b")


def frame(spark, rows, columns="a string, b string"):
    return spark.createDataFrame([(i + 1, i + 1, *r) for i, r in enumerate(rows)], f"kid long, tid long, {columns}")


def model(rows: list[tuple[str, str]], mode: str, step: int | None) -> list[tuple[bool, bool, str | None]]:
    """(violating, new, fix) of each tuple, straight from the definitions."""
    pane = lambda t: (t - 1) // step + 1 if step else 0
    seen = list(enumerate(rows, 1))
    flags = []
    for t, (a, _) in seen:
        own = [(u, y) for u, (x, y) in seen if x == a and u <= t and pane(u) >= pane(t) - 1]
        before = {y for u, y in own if u < t}
        flags.append((len({y for _, y in own}) > 1, len(before)))
    out = []
    for (t, (a, b)), (violating, n) in zip(seen, flags, strict=True):
        if not violating:
            out.append((False, False, None))
            continue
        least = pane(t) - 1
        if mode == "cumulative":
            birth = pane(t)
            while any(flags[u - 1][0] for u, (x, _) in seen if x == a and pane(u) == birth - 1):
                birth -= 1
            least = birth - 1
        own = [y for u, (x, y) in seen if x == a and u <= t and pane(u) >= least]
        out.append((True, n == 1, decide({y: own.count(y) for y in own}, b)))
    return out


rows_strategy = st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("xyz")), min_size=1, max_size=60)


@settings(max_examples=150, deadline=None)
@given(rows_strategy, st.sampled_from(["none", "basic", "cumulative"]), st.integers(2, 9))
def test_machines_follow_the_definitions(rows, mode, step):
    step = None if mode == "none" else step
    machines: dict[str, GroupMachine] = {}
    got = [machines.setdefault(a, GroupMachine(mode, step)).process(t, b) for t, (a, b) in enumerate(rows, 1)]
    assert got == model(rows, mode, step)


@settings(max_examples=5, deadline=None)
@given(rows_strategy, st.sampled_from(["none", "basic", "cumulative"]), st.integers(2, 9))
def test_batch_follows_the_definitions(spark, rows, mode, step):
    step = None if mode == "none" else step
    df = frame(spark, rows)
    want = model(rows, mode, step)
    assert [(r.violating, r.fix) for r in repair.repair_rule(df, RULE, mode, step).orderBy("tid").collect()] == [(v, f) for v, _, f in want]
    assert {(r.tid, r.is_new) for r in detect.detect(df, RULE, step).collect()} == {(t, n) for t, (v, n, _) in enumerate(want, 1) if v}


def test_chunks_give_the_same_as_one(spark, monkeypatch):
    rows = [("pq"[i * 7 % 3 % 2], "xyz"[i * i % 7 % 3]) for i in range(200)]
    monkeypatch.setattr(repair, "CHUNK", 16)
    assert [(r.violating, r.fix) for r in repair.repair_rule(frame(spark, rows), RULE).orderBy("tid").collect()] == [(v, f) for v, _, f in model(rows, "none", None)]


def class_model(rows, rules, upto):
    """The class of tuple `upto` over the first `upto` tuples: the distinct cells' values, or None."""
    seen = rows[:upto]
    causes = {}
    for j, col in enumerate(rules):
        for t, r in enumerate(seen, 1):
            causes.setdefault((j, r[col]), {})[t] = r[-1]
    causes = {vc: c for vc, c in causes.items() if len(set(c.values())) > 1}
    cells, grown = {}, {vc: c for vc, c in causes.items() if upto in c}
    while grown:
        for c in grown.values():
            cells.update(c)
        causes = {vc: c for vc, c in causes.items() if vc not in grown}
        grown = {vc: c for vc, c in causes.items() if cells.keys() & c.keys()}
    return cells


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pqrs"), st.sampled_from("klm"), st.sampled_from("xyz")), min_size=1, max_size=30))
def test_class_machine_repairs_by_prefix_components(rows):
    m = ClassMachine()
    for t, (a, b, v) in enumerate(rows, 1):
        violating, _, fix = m.process(t, v, [(0, a), (1, b)])
        cells = class_model(rows, (0, 1), t)
        assert violating == bool(cells)
        if cells:
            values = list(cells.values())
            assert fix == decide({x: values.count(x) for x in values}, v)
    m.keep_only({0, 1})
    m.keep_only({1})
    last = ClassMachine()
    for t, (_, b, v) in enumerate(rows, 1):
        last.process(t, v, [(1, b)])
    assert {frozenset(c.items()) for c in m.cells.values()} == {frozenset(c.items()) for c in last.cells.values()}


GOLDEN = {
    "clean": ([("a", "x"), ("a", "x")], [(False, False, None)] * 2),
    "new": ([("a", "x"), ("a", "y")], [(False, False, None), (True, True, "y")]),
    "append": ([("a", "x"), ("a", "y"), ("a", "x")], [(False, False, None), (True, True, "y"), (True, False, "x")]),
    "majority": ([("a", "x"), ("a", "x"), ("a", "y")], [(False, False, None)] * 2 + [(True, True, "x")]),
    "tie": ([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", "z")], [(False, False, None), (True, True, "x"), (True, False, "x"), (True, False, "y"), (True, False, "x")]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    rows, want = GOLDEN[name]
    df = frame(spark, rows)
    new = {r.tid: r.is_new for r in detect.detect(df, RULE).collect()}
    assert [(r.violating, new.get(r.tid, False), r.fix) for r in repair.repair_rule(df, RULE).orderBy("tid").collect()] == want


def test_golden_windows_conditions_and_life(spark):
    gone = frame(spark, [("a", "x"), ("b", "q"), ("b", "q"), ("b", "q"), ("a", "y")])
    assert detect.detect(gone, RULE, 2).count() == 0
    near = frame(spark, [("a", "x"), ("b", "q"), ("a", "y")])
    assert [(r.tid, r.is_new) for r in detect.detect(near, RULE, 2).collect()] == [(3, True)]
    skip = frame(spark, [("a", "x", "null"), ("a", "y", "k"), ("a", "z", ""), ("a", "w", None)], "a string, b string, c string")
    assert detect.detect(skip, parse_rule(0, "CFD,a,b,(c neq null)")).count() == 0
    late = dynamics.apply_control([], [(2, "add_rule", "0;FD,a,b")])[0]
    assert detect.detect(frame(spark, [("a", "x"), ("a", "y"), ("a", "y")]), late).count() == 0


def test_golden_classes(spark):
    df = frame(spark, [("k1", "l1", "x"), ("k1", "l2", "x"), ("k1", "l1", "y")], "k string, l string, v string")
    rules = [Rule(0, "k", "v"), Rule(1, "l", "v")]
    assert {r.kid: r.fix for r in classes.repair_shared(df, rules).collect()} == {1: "x", 2: "x", 3: "x"}
    left = classes.cells(df, dynamics.without(rules, 0)).collect()
    assert {(r.vc, r.kid) for r in left} == {("1:l1", 1), ("1:l1", 3)}


def test_rules_and_errors():
    assert parse_rule(3, " CFD , a, b ,( c  neq null ) ") == Rule(3, "a", "b", "c", "neq", "null")
    for bad in ("XX,a,b", "FD,a", "CFD,a,b,(c lt 3)", "CFD,a,b", "FD,a,b,c"):
        with pytest.raises(RuleDefinitionError):
            parse_rule(0, bad)
    with pytest.raises(RuleDefinitionError):
        RULE.validate(["a"])
    with pytest.raises(RuleDefinitionError):
        dynamics.apply_control([RULE], [(1, "add_rule", "0;FD,a,b")])
    with pytest.raises(RuleDefinitionError):
        dynamics.apply_control([], [(1, "del_rule", "0")])
    assert dynamics.apply_control([RULE], [(5, "del_rule", "0"), (7, "add_rule", "0;FD,b,a")]) == [Rule(0, "a", "b", to_tid=5), Rule(0, "b", "a", from_tid=7)]
    with pytest.raises(OrderError):
        m = GroupMachine("none", None)
        m.process(2, "x")
        m.process(2, "x")


def test_config(spark):
    text = "# comment\nx.schema=kid,a,b,c\nx.window=x\nx.window.size=100\nx.topology.rw=2\nkafka.data.delimiter=\\\\|\nx.rule.num=2\nx.rule.0=CFD,a,b,(c neq null)\n#x.rule.0=FD,b,c\nx.rule.1=FD,a,c\nx.rule.2=FD,c,a\nx.repair.proposal.size=7\nhdfs.window=false\n"
    c = parse_config(text)
    assert (c.mode, c.window_step, c.repair_mode, c.separator, c.proposal_size, len(c.rules)) == ("cumulative", 100, "immediate", "\\|", 7, 2)
    assert Cleaner.from_config(text.replace("x.window=x", "x.window=false")).step is None
    bad = [text.replace("x.window=x", f"x.window={w}") for w in ("odd", "kafka", "hdfs")] + [text.replace("rw=2", "rw=9"), text.replace("x.schema", "x.columns"), text.replace("rule.num=2", "rule.num=4"), text.replace("size=100", "size=many"), text + "y.schema=a\n"]
    for each in ("x.window=false", *bad):
        with pytest.raises(ConfigError):
            parse_config(each)
    assert parse_config(text + "y.schema=a\n", "x").mode == "cumulative"
    with pytest.raises(ConfigError):
        repair.repair_rule(spark.range(1), RULE, "basic")


def test_every_key_of_a_configuration():
    """Each key by itself, in any order, with white space and escapes; keys of other things are kept aside."""
    keys = {
        "depot.rule.1": "FD, shelf, aisle", "depot.rule.0": "CFD,sku,label,(shelf eq B7)", "depot.rule.num": "2",
        "depot.schema": "box, sku, label,shelf ,aisle", "depot.window": "Basic", "depot.window.size": "64", "depot.topology.rw": "1", "depot.topology.name": "night run",
        "depot.repair.proposal.size": "9", "depot.input": "/in/a=b", "depot.output": "/out", "kafka.topic": "boxes", "kafka.control.topic": "orders", "kafka.server": "broker",
        "kafka.data.delimiter": r"\\t", "other.thing": "1",
    }
    c = parse_config("! a remark\n\n" + "\n".join(f"  {k} = {v} " for k, v in keys.items()) + "\nno pair\n# depot.rule.num=7\n")
    assert c.columns == ["box", "sku", "label", "shelf", "aisle"]
    assert c.rules == [Rule(0, "sku", "label", "shelf", "eq", "B7"), Rule(1, "shelf", "aisle")]
    assert (c.mode, c.window_step, c.repair_mode, c.separator, c.proposal_size) == ("basic", 64, "delayed", r"\t", 9)
    assert (c.input, c.output, c.topic, c.control_topic, c.servers) == ("/in/a=b", "/out", "boxes", "orders", "broker:9092")
    assert c.other["other.thing"] == "1" and c.other["depot.topology.name"] == "night run"
    few = parse_config("depot.schema=a\nkafka.server=x\nkafka.server.port=7")
    assert (few.mode, few.window_step, few.rules, few.input, few.topic, few.servers) == ("none", None, [], None, None, "x:7")


def test_lines(spark):
    got = lines.parse_delimited(spark.createDataFrame([("1|a||",), ("x|b",), ("",)], "value string"), ["kid", "a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [(1, "a", "", ""), (None, "b", None, None), (None, None, None, None)]
    assert tuple(lines.parse_control(spark.createDataFrame([("add_rule|6;CFD,a,b,(c eq x|y)",)], "value string")).first()) == ("add_rule", "6;CFD,a,b,(c eq x|y)")


def test_tids_are_dense(spark):
    keys = [k * k % 10_007 for k in range(1, 3000)]
    df = spark.createDataFrame([(k,) for k in set(keys)], "kid long").repartition(7)
    assert [r.tid for r in with_tid(df).orderBy("kid").collect()] == list(range(1, len(set(keys)) + 1))
    assert with_tid(df.limit(0)).count() == 0


def test_rows_without_a_key_have_tids_too(spark):
    rows = [(None if i % 10 == 0 else 5 * i, i, "a", "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "kid long, n int, part string, AT string")
    got = with_tid(df).orderBy("tid").collect()
    assert [r.tid for r in got] == list(range(1, 1001)) and {(r.kid, r.n, r.part, r.AT) for r in got} == set(rows)
    assert [r.kid for r in got[:100]] == [None] * 100 and [r.kid for r in got[100:]] == sorted(r[0] for r in rows if r[0] is not None)
    assert sorted(r.tid for r in with_tid(spark.createDataFrame([(None, 7), (None, 7), (3, 7)], "kid long, tid int")).collect()) == [1, 2, 3]


@pytest.mark.parametrize(("mode", "step"), [("none", None), ("basic", 7), ("cumulative", 7)])
def test_streams_equal_batches(spark, mode, step):
    rows = [("pqrs"[i * 7 % 11 % 4], "xyz"[i * i % 7 % 3]) for i in range(120)]
    df = frame(spark, rows)
    got = drain(spark, df, Cleaner([RULE], mode, step), f"t_{mode}", batches=4, live=False).orderBy("tid").collect()
    assert [(r.violating, r.is_new, r.fix) for r in got] == model(rows, mode, step)


def test_shared_side_streams_in_both_modes(spark):
    rows = [("pqrs"[i * 7 % 11 % 4], "klm"[i % 3], "xyz"[i * i % 7 % 3]) for i in range(60)]
    df = frame(spark, rows, "k string, l string, v string")
    rules = [Rule(0, "k", "v"), Rule(1, "l", "v")]
    for mode in ("delayed", "immediate"):
        m = ClassMachine(mode == "immediate")
        want = [m.process(t, v, [(0, k), (1, x)]) for t, (k, x, v) in enumerate(rows, 1)]
        got = drain(spark, df, Cleaner(rules, repair_mode=mode), f"shared_{mode}", live=False).orderBy("tid").collect()
        assert [(r.violating, r.is_new, r.fix) for r in got] == want
    for mode in ("basic", "cumulative"):
        m = ClassMachine(False, mode, 7)
        want = [m.process(t, v, [(0, k), (1, x)]) for t, (k, x, v) in enumerate(rows, 1)]
        got = drain(spark, df, Cleaner(rules, mode, 7), f"shared_{mode}_window").orderBy("tid").collect()
        assert [(r.violating, r.is_new, r.fix) for r in got] == want


def test_only_rule_attributes_are_read(spark, tmp_path):
    frame(spark, [("a", "x", "u")] * 5, "a string, b string, c string").write.parquet(str(tmp_path / "t"))
    plan = detect.detect(spark.read.parquet(str(tmp_path / "t")), parse_rule(0, "CFD,a,b,(a eq a)"))._jdf.queryExecution().toString()
    assert "c:string" not in plan.split("ReadSchema")[1].split("\n")[0]
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and all("PushedFilters: [" in x for x in scans)


def test_clean_tuples_stay_and_only_right_sides_change(spark):
    rows = [("pq"[i % 2], "xyz"[i * i % 7 % 3], str(i)) for i in range(50)]
    df = frame(spark, rows, "a string, b string, c string")
    out = {r.kid: r for r in Cleaner([RULE]).repair(df).collect()}
    assert len(out) == 50 and all(out[i + 1].a == a and out[i + 1].c == c for i, (a, _, c) in enumerate(rows))
    assert all(r.b == rows[k - 1][1] for k, r in out.items() if not r.repaired) and {r.b for r in out.values()} <= {"x", "y", "z"}
    assert df.join(Cleaner([RULE]).repair(df).where(F.col("changed") & ~F.col("repaired")), "kid").count() == 0


def window_classes(rows: list[tuple], mode: str, step: int) -> dict[int, str]:
    """kid -> fix by the classes at the end of each pane, for rules k -> v and l -> v over rows (k, l, v)."""
    pane = {t: (t - 1) // step + 1 for t in range(1, len(rows) + 1)}
    groups: dict[tuple, list[int]] = {}
    for t, (k, x, _) in enumerate(rows, 1):
        groups.setdefault((0, k), []).append(t)
        groups.setdefault((1, x), []).append(t)
    value = {t: r[2] for t, r in enumerate(rows, 1)}
    out: dict[int, str] = {}
    for w in range(1, max(pane.values()) + 1):
        causes: dict[tuple, tuple[list[int], bool]] = {}
        for vc, own in groups.items():
            def violating(p: int, own: list[int] = own) -> bool:
                return any(pane[t] == p for t in own) and len({value[t] for t in own if pane[t] in (p - 1, p)}) > 1

            if mode == "basic":
                live = [t for t in own if pane[t] in (w - 1, w)]
                if len({value[t] for t in live}) > 1:
                    causes[vc] = live, True
            else:
                end = w if violating(w) else w - 1 if violating(w - 1) else None
                if end is not None:
                    birth = end
                    while violating(birth - 1):
                        birth -= 1
                    causes[vc] = [t for t in own if birth - 1 <= pane[t] <= w], end == w
        parts = [({vc}, set(live)) for vc, (live, _) in causes.items()]
        merged = True
        while merged:
            merged = False
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    if parts[i][1] & parts[j][1]:
                        parts[i] = parts[i][0] | parts[j][0], parts[i][1] | parts[j][1]
                        del parts[j]
                        merged = True
                        break
                if merged:
                    break
        for vcs, live in parts:
            counts = Counter(value[t] for t in live)
            for t in live:
                if pane[t] == w and any(bad and t in own for vc in vcs for own, bad in [causes[vc]]):
                    out[t] = decide(counts, value[t])
    return out


@pytest.mark.parametrize("mode", ["basic", "cumulative"])
def test_windows_with_a_shared_right_hand_side(spark, mode):
    import random

    for seed in range(3):
        r = random.Random(seed)
        rows = [(r.choice("pqrstuvw"), r.choice("abcdefgh"), r.choice("xxxxyz")) for _ in range(70)]
        rules = [Rule(0, "k", "v"), Rule(1, "l", "v")]
        got = {x.kid: x.fix for x in Cleaner(rules, mode, 6).fixes(frame(spark, rows, "k string, l string, v string")).collect()}
        assert got == window_classes(rows, mode, 6)


@pytest.mark.parametrize("mode", ["basic", "cumulative"])
def test_window_machine_of_shared_sides(mode):
    """The last tuple of a pane is decided by the classes as they stand at its end; a lone rule gives what its group machine gives; state is let go."""
    import random

    for seed in range(60):
        r = random.Random(seed)
        rows = [(r.choice("pqrstuvw"), r.choice("abcdefgh"), r.choice("xxxxyz")) for _ in range(70)]
        m = ClassMachine(False, mode, 6)
        got = {t: m.process(t, v, [(0, k), (1, x)]) for t, (k, x, v) in enumerate(rows, 1)}
        for t in range(6, 71, 6):
            want = window_classes(rows[:t], mode, 6)
            assert got[t][0] == (t in want) and got[t][2] == want.get(t)
        assert all(t > 70 - 12 for g in m.groups.values() for t in g)
        one, own = ClassMachine(False, mode, 6), {}
        for t, (k, _, v) in enumerate(rows, 1):
            assert one.process(t, v, [(0, k)]) == own.setdefault(k, GroupMachine(mode, 6)).process(t, v)


def job_config(tmp_path, window: str = "false") -> str:
    return f"x.schema=key,zip,city\nx.window={window}\nx.window.size=50\nx.rule.num=1\nx.rule.0=CFD,zip,city,(zip neq null)\nx.input={tmp_path}/in\nx.output={tmp_path}/out\nkafka.data.delimiter=\\\\|\n"


def test_a_job_from_lines_to_lines(spark, tmp_path):
    from siltsieve.plans.job import run_batch

    rows = [(i, "pq"[i % 2], "b" if i == 7 else "a") for i in range(1, 12)] + [(12, "null", "c"), (13, "", "d")]
    spark.createDataFrame([("|".join(map(str, r)),) for r in rows], "value string").write.text(f"{tmp_path}/in")
    run_batch(spark, job_config(tmp_path))
    got = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert got == sorted("|".join(map(str, (i, z, "a" if i == 7 else c))) for i, z, c in rows)
    with pytest.raises(ConfigError):
        run_batch(spark, job_config(tmp_path).replace("x.input", "x.other"))


def test_every_line_of_a_job_goes_somewhere(spark, tmp_path):
    from siltsieve.plans.job import run_batch

    good, bad = ["1|p|A", "2|p|A", "3|p|B", "4|q"], ["broken|x|A", "|y|C", "", "1.5|z|D"]
    spark.createDataFrame([(x,) for x in good + bad], "value string").write.text(f"{tmp_path}/in")
    out = run_batch(spark, job_config(tmp_path))
    assert {(r.kid, r.city, r.repaired) for r in out.collect()} == {(1, "A", False), (2, "A", False), (3, "A", True), (4, None, False)}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["1|p|A", "2|p|A", "3|p|A", "4|q|"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out_bad").collect()) == sorted(bad)


@pytest.mark.parametrize("bad", [False, True])
def test_a_stream_job_and_its_metrics(spark, tmp_path, bad):
    import time

    from siltsieve.plans.job import start_stream
    from siltsieve.streaming.metrics import Throughput

    rows = [(i, "pq"[i % 2], "xyz"[i * i % 7 % 3]) for i in range(1, 41)]
    keys = [1 if bad else r[0] for r in rows]  # equal keys are out of order
    spark.createDataFrame([(f"{k}|{z}|{c}",) for k, (_, z, c) in zip(keys, rows, strict=True)], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    seen = Throughput()
    spark.streams.addListener(seen)
    try:
        q = start_stream(spark, job_config(tmp_path, "basic"), lines=lines.stream_lines(spark, f"{tmp_path}/in"), name=f"job-{bad}-{tmp_path.name}")
        if bad:
            with pytest.raises(Exception):  # noqa: B017
                q.awaitTermination()
        else:
            q.awaitTermination()
        for _ in range(100):
            if seen.failures if bad else seen.rows >= 40:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    if bad:
        assert seen.report()["failures"] == 1
        return
    assert seen.report()["rows"] == 40 and seen.report()["failures"] == 0 and seen.report()["rows_per_second"] > 0
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("tid").collect()
    machines = {z: GroupMachine("basic", 50) for z in "pq"}
    assert [(r.violating, r.is_new, r.fix) for r in got] == [machines[z].process(i, c) for i, z, c in rows]


def test_probes_tell_how_long_tuples_take(spark, tmp_path):
    import time

    from siltsieve.streaming.metrics import Throughput, probed

    spark.range(1, 251).selectExpr("id AS tid", "current_timestamp() - INTERVAL 50 SECONDS AS arrived").coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = Throughput()
    spark.streams.addListener(seen)
    try:
        sdf = probed(spark.readStream.schema("tid long, arrived timestamp").parquet(f"{tmp_path}/in"))
        sdf.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if seen.probes:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    got = seen.report()
    assert got["probes"] == 2 and 50_000 <= got["probe_p95_ms"] < 400_000


def test_a_kind_of_rule_of_ones_own(spark, tmp_path):
    from siltsieve.functions import rules as kinds
    from siltsieve.streaming.live import LiveCleaner

    class Region(Rule):
        """The first two letters of lhs decide rhs."""

        def left(self):
            return F.substring(kinds.value(self.lhs), 1, 2)

        @property
        def text(self):
            return f"REGION,{self.lhs},{self.rhs}"

    def parse(rid, rest):
        parts = rest.split(",")
        return Region(rid, *parts) if len(parts) == 2 else None

    if "REGION" not in kinds.KINDS:
        kinds.add_kind("REGION", parse)
    with pytest.raises(RuleDefinitionError):
        kinds.add_kind("FD", parse)
    with pytest.raises(RuleDefinitionError):
        parse_rule(0, "REGION,a")
    rule = parse_rule(4, "REGION,k,v")
    assert parse_rule(4, rule.text) == rule
    rows = [(f"{'ab'[i % 2]}{'xy'[i % 3 % 2]}{i}", "pqr"[i * i % 7 % 3]) for i in range(40)]
    df = frame(spark, rows, "k string, v string")
    plain = frame(spark, [(k[:2], v) for k, v in rows], "k string, v string")
    want = {(r.kid, r.fix) for r in Cleaner([Rule(4, "k", "v")]).fixes(plain).collect()}
    assert want and {(r.kid, r.fix) for r in Cleaner([rule]).fixes(df).collect()} == want
    assert {r.kid for r in Cleaner([rule]).detect(df).collect()} == {k for k, _ in want}
    live = LiveCleaner(spark, [rule], f"{tmp_path}/live")
    live.process(df.where("tid <= 15"), 0)
    live.process(df.where("tid > 15"), 1)
    assert {(r.kid, r.fix) for r in spark.read.parquet(f"{live.place}/decisions").where("violating").collect()} == want


def test_what_is_cut_is_read_by_column(spark):
    from siltsieve.functions.shared import cut

    df = cut(frame(spark, [("a", "x", "u")] * 5, "a string, b string, c string"))
    plan = df.groupBy("b").count()._jdf.queryExecution().toString()
    assert "c:string" not in plan.split("ReadSchema")[1].split("\n")[0]
