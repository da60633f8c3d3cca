"""Rules that come and go: every control message takes effect at one place in the order of tuples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from ..errors import RuleDefinitionError
from ..functions.rules import Rule, parse_rule

ADD, DROP = "add_rule", "del_rule"
#: Messages that other stages of a dataflow would need besides; here one message of each pair is enough.
IGNORED = ("dw_add_rule", "rw_del_rule")


def apply_control(rules: Sequence[Rule], messages: Iterable[tuple[int, str, str]]) -> list[Rule]:
    """The rules with their lives after messages (tid, name, payload): `rid;RULE` to add, `rid` to drop. A rule added at tid sees no tuple before it; one dropped at tid sees none from it on."""
    out = list(rules)
    for tid, name, payload in sorted(messages, key=lambda m: m[0]):
        if name in IGNORED:
            continue
        if name not in (ADD, DROP):
            raise RuleDefinitionError(f"unknown control message {name}")
        rid_text, _, text = payload.partition(";")
        rid = int(rid_text)
        live = [i for i, r in enumerate(out) if r.rid == rid and r.to_tid is None]
        if name == ADD:
            if live:
                raise RuleDefinitionError(f"rule {rid} is there already")
            out.append(replace(parse_rule(rid, text), from_tid=tid))
        elif live:
            out[live[0]] = replace(out[live[0]], to_tid=tid)
        else:
            raise RuleDefinitionError(f"no rule {rid} to drop")
    return out


def without(rules: Sequence[Rule], rid: int) -> list[Rule]:
    """The rules that count for classes once a rule is dropped: its causes go, and classes held together by it split."""
    return [r for r in rules if r.rid != rid]
