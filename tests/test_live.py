"""A running cleaner against the models that take tuples one by one, with batches cut anywhere."""

from __future__ import annotations

import random

import pytest

from siltsieve.functions.rules import Rule
from siltsieve.plans.cleaner import Cleaner
from siltsieve.streaming.live import LiveCleaner
from siltsieve.streaming.machines import ClassMachine, GroupMachine

SCHEMA = "kid long, tid long, k string, l string, v string"
PAIR = [Rule(0, "k", "v"), Rule(1, "l", "v")]


def rows_of(n, seed=3, keys=9):
    r = random.Random(seed)
    return [(100 + t, t, f"k{r.randrange(keys)}", f"l{int(keys * r.random() ** 3)}", f"v{int(4 * r.random() ** 2)}") for t in range(1, n + 1)]


def batches(rows, cuts):
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def run(spark, live, rows, cuts, messages=None):
    for i, own in enumerate(batches(rows, cuts)):
        live.process(spark.createDataFrame(own, SCHEMA), i, (messages or {}).get(i, ()))
    got = spark.read.option("basePath", f"{live.place}/decisions").parquet(*[f"{live.place}/decisions/batch={i}" for i in range(len(cuts) + 1)]).collect()
    return {(r.tid, r.attr): (r.violating, r.is_new, r.fix) for r in got}


def group_model(rows, mode, step, lhs=2):
    machines, out = {}, {}
    for row in rows:
        out[row[1], "v"] = machines.setdefault(row[lhs], GroupMachine(mode, step)).process(row[1], row[4])
    return out


@pytest.mark.parametrize(("mode", "step"), [("none", None), ("basic", 12), ("cumulative", 12)])
def test_single_rules_in_any_batches(spark, tmp_path, mode, step):
    rows = rows_of(110)
    live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/live", mode, step, every=2)
    assert run(spark, live, rows, [31, 67]) == group_model(rows, mode, step)
    whole = spark.read.parquet(f"{live.place}/tuples").collect()
    assert sorted(r.kid for r in whole) == [r[0] for r in rows]
    want = {t: (f or next(r[4] for r in rows if r[1] == t)) for (t, _), (_, _, f) in group_model(rows, mode, step).items()}
    assert {r.tid: r.v for r in whole} == want


def test_groups_of_passed_panes_leave_the_state(spark, tmp_path):
    rows = [(t, t, f"k{t // 10}", "l", f"v{t % 2}") for t in range(1, 101)]
    for mode in ("basic", "cumulative"):
        live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/{mode}", mode, 10, every=2)
        run(spark, live, rows, [45, 85])
        base = spark.read.parquet(f"{live.place}/state/sums/base-2").collect()
        assert {r.l for r in base} == {"k7", "k8"} and min(r.p for r in base) >= 8  # of 85 tuples in 9 panes


def shared_model(rows, cuts_of_rules):
    """cuts_of_rules: (first place, rules) in order."""
    m, out = ClassMachine(), {}
    for row in rows:
        rules = [r for at, r in cuts_of_rules if at <= row[1]][-1]
        m.keep_only({r.rid for r in rules})
        own = dict(zip(("kid", "tid", "k", "l", "v"), row, strict=True))
        out[row[1], "v"] = m.process(row[1], row[4], [(r.rid, own[r.lhs]) for r in rules])
    return out


def test_classes_in_any_batches(spark, tmp_path):
    rows = rows_of(90, keys=14)
    live = LiveCleaner(spark, PAIR, f"{tmp_path}/live")
    assert run(spark, live, rows, [40]) == shared_model(rows, [(1, PAIR)])
    state = spark.read.parquet(f"{live.place}/state/classes/1")
    assert state.count() > 15  # a row for each cause


def test_rules_come_and_go_while_it_runs(spark, tmp_path):
    rows = rows_of(80, seed=8)
    live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/live")
    messages = {1: [("add_rule", "1;FD,l,v"), ("add_rule", "x"), ("grow_rule", "1"), ("add_rule", "7;FD,nothing,v")], 2: [("del_rule", "0")]}
    got = run(spark, live, rows, [25, 55], messages)
    assert got == shared_model(rows, [(1, PAIR[:1]), (26, PAIR), (56, PAIR[1:])])
    assert live.report["bad_messages"] == 3 and spark.read.parquet(f"{live.place}/bad_messages").count() == 3


def test_a_running_query_with_control_and_replays(spark, tmp_path):
    rows = rows_of(60)
    at = random.Random(1).randrange(15, 45)
    live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/live")

    def go():
        data = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/data")
        control = spark.readStream.schema("name string, payload string").parquet(f"{tmp_path}/control")
        live.start(data, control).awaitTermination()

    def put(own, *messages):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/data")
        spark.createDataFrame(messages, "name string, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/control")

    put(rows[:at])
    go()
    put(rows[:7] + rows[at:], ("del_rule", "0"), ("add_rule", "5;FD,l,v"))  # with a replay
    go()
    got = spark.read.parquet(f"{live.place}/decisions").collect()
    late = Cleaner([Rule(5, "l", "v", from_tid=at + 1)])
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.kid for r in late.detect(df).collect()} | {r.kid for r in Cleaner(PAIR[:1]).detect(df.where(f"tid <= {at}")).collect()}
    assert {r.kid for r in got if r.violating} == want
    assert len(got) == len(rows) == spark.read.parquet(f"{live.place}/tuples").count() and live.report["rows"] == len(rows) and live.report["replays"] == 7


def test_micro_batches_of_many_files(spark, tmp_path):
    from siltsieve.streaming.run import drain_live

    rows = rows_of(80, seed=4)
    live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/live")
    drain_live(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), live, [31, 61], {1: [("add_rule", "1;FD,l,v")]})
    got = spark.read.parquet(f"{live.place}/decisions").collect()
    assert {(r.tid, r.attr): (r.violating, r.is_new, r.fix) for r in got} == shared_model(rows, [(1, PAIR[:1]), (31, PAIR)])
    assert {r.batch for r in got} == {0, 1, 2}
    assert len(spark.read.parquet(f"{live.place}/in").inputFiles()) > 6  # no part goes through one task


def test_keys_that_come_twice_in_a_batch(spark, tmp_path):
    rows = rows_of(40)
    twice = [rows[3], rows[30], (rows[5][0], 39, "k0", "l0", "v9"), (rows[12][0], 40, "k0", "l0", "v9")]
    live = LiveCleaner(spark, PAIR[:1], f"{tmp_path}/live")
    got = run(spark, live, rows[:38] + twice, [])
    assert got == group_model(rows[:38], "none", None) and live.report["replays"] == 4
    assert spark.read.parquet(f"{live.place}/tuples").count() == 38 == spark.read.parquet(f"{live.place}/state/log/batch-0").count()
