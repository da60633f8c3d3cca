"""What a stream keeps for a key: tuples come in order, each gets its decision at once."""

from __future__ import annotations

from collections import Counter

from ..errors import OrderError


def decide(counts: dict[str, int], own: str) -> str:
    """The most frequent value; own if it is among them, else the smallest."""
    most = max(counts.values())
    return own if counts.get(own) == most else min(v for v, n in counts.items() if n == most)


class GroupMachine:
    """One group of one rule whose right-hand side is its own."""

    def __init__(self, mode: str, step: int | None) -> None:
        self.mode, self.step = mode, step
        self.last, self.pane, self.violated = 0, 0, -2
        self.old: dict[str, int] = {}
        self.now: dict[str, int] = {}
        self.held: dict[str, int] = {}

    def process(self, tid: int, value: str) -> tuple[bool, bool, str | None]:
        """(violating, new, fix)."""
        if tid <= self.last:
            raise OrderError(f"tuple {tid} comes after {self.last}")
        self.last = tid
        if self.mode != "none":
            pane = (tid - 1) // self.step + 1
            if pane != self.pane:
                self.old, self.now, self.pane = (self.now if pane == self.pane + 1 else {}), {}, pane
            if self.violated < pane - 1:
                self.held = {}
        before = len(self.old.keys() | self.now.keys())
        self.now[value] = self.now.get(value, 0) + 1
        violating = len(self.old.keys() | self.now.keys()) > 1
        window = Counter(self.old) + Counter(self.now) if self.mode != "none" and violating else self.now
        if self.mode == "cumulative":
            if self.held:
                self.held[value] = self.held.get(value, 0) + 1
            elif violating:
                self.held = dict(window)
        if not violating:
            return False, False, None
        self.violated = self.pane
        return True, before == 1, decide(self.held if self.mode == "cumulative" else window, value)


class ClassMachine:
    """All groups of the rules that share a right-hand side; classes of causes are merged as tuples link them.

    With a window, groups hold the tuples of two panes, and a new pane lets go of those before. In
    basic mode a cause is a group with two values there. In cumulative mode a cause keeps its cells
    until a whole pane has passed without a violation of it.
    """

    def __init__(self, immediate: bool = False, mode: str = "none", step: int | None = None) -> None:
        self.immediate, self.mode, self.step, self.last, self.pane = immediate, mode, step, 0, 0
        self.groups: dict[tuple[int, str], dict[int, str]] = {}
        self.values: dict[tuple[int, str], Counter] = {}  # of each group
        self.kept: dict[tuple[int, str], dict[int, str]] = {}  # cells of each cause
        self.violated: dict[tuple[int, str], int] = {}  # last pane
        self.causes: dict[int, set[tuple[int, str]]] = {}  # of each tuple
        self.root: dict[tuple[int, str], tuple[int, str]] = {}
        self.cells: dict[tuple[int, str], dict[int, str]] = {}  # of each class
        self.rids: set[int] = set()

    def _find(self, vc: tuple[int, str]) -> tuple[int, str]:
        while self.root[vc] != vc:
            self.root[vc] = vc = self.root[self.root[vc]]
        return vc

    def _merge(self, a: tuple[int, str], b: tuple[int, str]) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            if len(self.cells[a]) < len(self.cells[b]):
                a, b = b, a
            self.root[b] = a
            self.cells[a].update(self.cells.pop(b))

    def _add_cause(self, vc: tuple[int, str], kept: dict[int, str]) -> None:
        self.root[vc], self.cells[vc], self.kept[vc] = vc, dict(kept), kept
        for tid in kept:
            self.causes.setdefault(tid, set()).add(vc)

    def _rebuild(self, kept: dict[tuple[int, str], dict[int, str]]) -> None:
        self.causes, self.root, self.cells, self.kept = {}, {}, {}, {}
        for vc, own in kept.items():
            self._add_cause(vc, own)
        for own in self.causes.values():
            first, *rest = own
            for vc in rest:
                self._merge(first, vc)

    def keep_only(self, rids: set[int]) -> None:
        """Drop all rules but these, and split classes that only they held together."""
        if self.rids <= rids:
            self.rids |= rids
            return
        self.rids = set(rids)
        for table in (self.groups, self.values, self.violated):
            for vc in [vc for vc in table if vc[0] not in rids]:
                del table[vc]
        self._rebuild({vc: own for vc, own in self.kept.items() if vc[0] in rids})

    def _slide(self, pane: int) -> None:
        self.pane, first = pane, (pane - 2) * self.step + 1
        for vc, g in list(self.groups.items()):
            if own := {t: v for t, v in g.items() if t >= first}:
                self.groups[vc], self.values[vc] = own, Counter(own.values())
            else:
                del self.groups[vc], self.values[vc]
        if self.mode == "basic":
            self._rebuild({vc: dict(g) for vc, g in self.groups.items() if len(self.values[vc]) > 1})
        else:
            self.violated = {vc: p for vc, p in self.violated.items() if p >= pane - 1}
            self._rebuild({vc: own for vc, own in self.kept.items() if vc in self.violated})

    def process(self, tid: int, value: str, groups: list[tuple[int, str]]) -> tuple[bool, bool, str | None]:
        """(violating, new to some rule, fix); groups: (rid, lhs) of each rule that sees the tuple."""
        if tid <= self.last:
            raise OrderError(f"tuple {tid} comes after {self.last}")
        self.last = tid
        if self.mode != "none" and (pane := (tid - 1) // self.step + 1) != self.pane:
            self._slide(pane)
        own, new = [], []
        for vc in groups:
            g, values = self.groups.setdefault(vc, {}), self.values.setdefault(vc, Counter())
            before = len(values)
            g[tid] = value
            values[value] += 1
            if vc in self.root:
                self.cells[self._find(vc)][tid] = self.kept[vc][tid] = value
                self.causes.setdefault(tid, set()).add(vc)
            elif len(values) > 1:
                self._add_cause(vc, dict(g))
            if len(values) > 1:
                own.append(vc)
                self.violated[vc] = self.pane
                if before == 1:
                    new.append(vc)
        if not own:
            # Causes that the tuple links without violating, in cumulative mode.
            for vc in list(self.causes.get(tid, ()))[1:]:
                self._merge(vc, next(iter(self.causes[tid])))
            return False, False, None
        for vc in self.causes[tid]:
            self._merge(own[0], vc)
        early = self._fix(own[0], value) if self.immediate else None
        for vc in new:
            for other in {x for t in self.groups[vc] for x in self.causes.get(t, ())}:
                self._merge(vc, other)
        return True, bool(new), early or self._fix(own[0], value)

    def _fix(self, vc: tuple[int, str], value: str) -> str:
        return decide(Counter(self.cells[self._find(vc)].values()), value)
