"""Detection and repair on streams with keyed state.

A right-hand side with one rule has a key for each of its groups, so state is spread as the data are.
One with several rules has one key: its classes depend on the order of all their tuples. Where that
is too much, use the batch operators, which find the classes of the final state.

Rules may change between runs of a query on one checkpoint: groups of new rules start empty, and
classes let go of rules that are no longer there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import Rule
from .machines import ClassMachine, GroupMachine

OUT = "kid long, tid long, attr string, violating boolean, is_new boolean, fix string"


def repair_stream(sdf: DataFrame, rules: Sequence[Rule], mode: str = "none", step: int | None = None, repair_mode: str = "delayed") -> DataFrame:
    """OUT for every tuple and right-hand side of which a rule sees it. sdf: kid, tid and attributes; tids grow from batch to batch, within a batch they are put in order."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.rhs, []).append(r)
    rids = {attr: {r.rid for r in own} for attr, own in by.items()}
    sides = []
    for attr, own in by.items():
        groups = F.filter(F.array(*[F.when(r.sees(), F.struct(F.lit(r.rid).alias("rid"), r.left().alias("l"))) for r in own]), lambda x: x.isNotNull())
        key = F.lit(f"class:{attr}") if len(own) > 1 else F.concat(F.lit(f"{own[0].rid}:"), own[0].left())
        sides.append(F.struct(key.alias("key"), F.lit(attr).alias("attr"), own[0].right().alias("r"), groups.alias("groups")))
    rows = sdf.select("kid", "tid", F.explode(F.array(*sides)).alias("s")).select("kid", "tid", "s.*").where(F.size("groups") > 0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole = key[0].startswith("class:")
        machine = pickle.loads(state.get[0]) if state.exists else ClassMachine(repair_mode == "immediate", mode, step) if whole else GroupMachine(mode, step)
        held = list(batches)
        data = held[0] if len(held) == 1 else pd.concat(held)
        if len(data) > 1:
            data = data.sort_values("tid")
        if whole:
            machine.keep_only(rids[key[0].removeprefix("class:")])
        tids, values = data["tid"].tolist(), data["r"].tolist()
        if whole:
            got = [machine.process(t, r, [(int(g["rid"]), g["l"]) for g in groups]) for t, r, groups in zip(tids, values, data["groups"], strict=True)]
        else:
            got = [machine.process(t, r) for t, r in zip(tids, values, strict=True)]
        state.update((pickle.dumps(machine),))
        violating, new, fix = zip(*got, strict=True)
        yield pd.DataFrame({"kid": data["kid"].to_numpy(), "tid": tids, "attr": data["attr"].to_numpy(), "violating": violating, "is_new": new, "fix": fix})

    return rows.groupBy("key").applyInPandasWithState(run, OUT, "machine binary", "append", GroupStateTimeout.NoTimeout)
