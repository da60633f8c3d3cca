"""Repair on arrival for rules that share a right-hand side, against the model that takes tuples one by one."""

from __future__ import annotations

import random

import pytest

from siltsieve.functions.rules import Rule
from siltsieve.operators import arrival, classes
from siltsieve.streaming.machines import ClassMachine

RULES = [Rule(0, "k", "v"), Rule(1, "l", "v"), Rule(2, "m", "v", "k", "neq", "p")]


def model(rows, rules):
    m, out = ClassMachine(), {}
    for t, row in enumerate(rows, 1):
        own = dict(zip("klmv", row, strict=True))
        groups = [(r.rid, own[r.lhs]) for r in rules if r.matches(own)]
        if groups:
            out[t] = m.process(t, own["v"], groups)
    return out


def mixed():
    """Several kinds of dirt, whose tuples come mixed; and a long chain of classes, each of which the next tuple joins to all before."""
    r = random.Random(7)
    out = [("3", f"a{i // 2}", f"b{(i + 1) // 2}", "m", "xyz"[i % 3]) for i in range(40)]
    for case, n, keys, values in (("0", 60, 3, 2), ("1", 120, 25, 3), ("2", 150, 60, 12)):
        out += [(case, f"{'pqrs'[r.randrange(4)]}{r.randrange(keys)}" if r.random() < 0.9 else "p", f"l{int(keys * r.random() ** 3)}", f"m{r.randrange(keys)}", f"v{int(values * r.random() ** 2)}") for _ in range(n)]
    order = sorted(range(len(out)), key=lambda i: (r.random(), i) if out[i][0] != "3" else (i / 40, i))
    return [(k if k == "p" else f"{c}{k}", f"{c}{x}", f"{c}{m}", v) for c, k, x, m, v in (out[i] for i in order)]


@pytest.mark.parametrize(("rules", "bound"), [(RULES, arrival.BOUND), (RULES[:2], 40), (RULES[:1], arrival.BOUND)])
def test_equals_the_model_tuple_by_tuple(spark, rules, bound):
    rows = mixed()
    df = spark.createDataFrame([(10 * t, t, *row) for t, row in enumerate(rows, 1)], "kid long, tid long, k string, l string, m string, v string").repartition(5)
    got = arrival.repair_shared_arrival(df, rules, bound).collect()
    assert {r.tid: (r.violating, r.is_new, r.fix) for r in got} == model(rows, rules)
    assert len(got) == len({r.tid for r in got}) and all(r.kid == 10 * r.tid for r in got)
    if len(rules) == 3:
        assert arrival.repair_shared_arrival(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("rules", [RULES, RULES[:2], RULES[:1]])
def test_immediate_repair_equals_the_model_tuple_by_tuple(spark, rules):
    rows, m, want = mixed(), ClassMachine(True), {}
    for t, row in enumerate(rows, 1):
        own = dict(zip("klmv", row, strict=True))
        if groups := [(r.rid, own[r.lhs]) for r in rules if r.matches(own)]:
            want[t] = m.process(t, own["v"], groups)
    df = spark.createDataFrame([(10 * t, t, *row) for t, row in enumerate(rows, 1)], "kid long, tid long, k string, l string, m string, v string").repartition(5)
    got = arrival.repair_shared_arrival(df, rules, immediate=True).collect()
    assert {r.tid: (r.violating, r.is_new, r.fix) for r in got} == want
    assert len(got) == len(want)
    if len(rules) > 1:
        assert want != model(rows, rules)


def test_ways_are_short(spark):
    n = 300
    links = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}", i + 1) for i in range(n)], "a string, b string, w long")
    merges = arrival.merge_order(links)
    way = arrival.ways(merges)
    assert merges.count() == n
    longest = max(len(r.way) for r in way.collect())
    assert longest <= 9  # log2 of the causes
    assert all([x.w for x in r.way] == sorted(x.w for x in r.way) for r in way.collect())


def test_windowed_classes_take_rows_in_proportion_to_panes(spark):
    """One hot group that violates in every pane, and others that come and go."""
    rules, step, sizes = RULES[:2], 20, []
    for panes in (10, 20, 40):
        rows = [(t, t, "hot", f"l{t // 7}", f"v{t % 3}") for t in range(1, panes * step + 1)]
        df = spark.createDataFrame(rows, "kid long, tid long, k string, l string, v string")
        _, cells = classes.window_cells(df, rules, "cumulative", step)
        sizes.append((cells.count(), classes.window_counts(classes.window_changes(cells)).count(), classes.window_links(cells).count()))
    for a, b in zip(sizes, sizes[1:]):
        assert all(y <= 2.3 * x for x, y in zip(a, b)), sizes
    assert sizes[0][0] <= 10 * step


def test_a_class_of_too_many_values_counts_what_is_live(spark):
    from siltsieve.operators import repair

    # Pane 1 has 'old' four times; later panes of 5 bring a new value with each tuple.
    rows = [(t, t, "k", "l", "old" if t <= 4 or t in (25, 30) else f"v{t}") for t in range(1, 31)]
    df = spark.createDataFrame(rows, "kid long, tid long, k string, l string, v string")
    free = {r.tid: r.fix for r in repair.repair_rule(df, RULES[0], "cumulative", 5).collect()}
    some = {r.tid: r.fix for r in repair.repair_rule(df, RULES[0], "cumulative", 5, value_limit=8).collect()}
    assert set(list(free.values())[5:]) == {"old"}
    # Panes 1 and 2 have 7 values, with pane 3 there are 12: from pane 4 on, panes 3 and 4 count.
    assert all(some[t] == "old" for t in range(6, 16)) and all(some[t] == f"v{t}" for t in range(16, 25))


def limit_model(rows, step, limit):
    """{(pane): birth} of one group's tuples (tid, value)."""
    of, out, birth = {}, {}, None
    for t, v in rows:
        of.setdefault((t - 1) // step + 1, set()).add(v)
    for p in sorted(of):
        if len(of[p] | of.get(p - 1, set())) < 2:
            continue
        if p - 1 not in out:
            birth = p
        elif len(set().union(*(of.get(q, set()) for q in range(birth - 1, p)))) > limit:
            birth = p
        out[p] = birth
    return out


def test_many_resets_take_one_walk(spark, monkeypatch):
    from siltsieve.operators import repair

    r, step, jobs = random.Random(5), 6, []
    cut = repair.cut
    monkeypatch.setattr(repair, "cut", lambda df: jobs.append(1) or cut(df))
    for limit in (1, 3, 20):
        kinds = {k: [(t, f"v{r.randrange(n)}") for t in range(1, 400) if r.random() < share] for k, n, share in (("a", 2, 0.3), ("b", 30, 1), ("c", 400, 0.9), ("d", 5, 0.5), ("e", 1, 1))}
        rows = spark.createDataFrame([(k, (t - 1) // step + 1, v) for k, own in kinds.items() for t, v in own], "l string, p long, r string").repartition(5)
        jobs.clear()
        got = repair.limited(repair.episodes(repair.violating_panes(rows)), rows, limit).collect()
        assert {(x.l, x.p): x.birth for x in got} == {(k, p): b for k, own in kinds.items() for p, b in limit_model(own, step, limit).items()}
        assert len(jobs) < 3  # a round for each reset before
