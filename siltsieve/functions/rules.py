"""Rules: functional dependencies LHS -> RHS, on all tuples or on those that meet one condition.

Text form: `FD,lhs,rhs` or `CFD,lhs,rhs,(attribute op value)` with op `eq` or `neq`; white space
around the parts does not matter. Missing values are empty strings: SQL NULL counts as one, and
`neq` is false for them. The text `null` is an ordinary value.

Other kinds of rules derive from Rule. What the operators, in batch and on streams, ask of a rule is
what it says of a tuple as columns: `sees` (whether it applies), `left` and `right` (text, by which tuples are
grouped and what has to agree in a group), besides `rhs` (the attribute that is repaired), `attributes`
(all that it reads) and `text` (a form that parse_rule reads again, by the name given to add_kind).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RuleDefinitionError

RULES_SCHEMA = "rid int, kind string, lhs string, rhs string, cond_attr string, op string, cond_val string, from_tid long, to_tid long"


def value(name: str) -> Column:
    """An attribute as text, with an empty string for NULL."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A rule that sees tuples from from_tid (included) up to to_tid (left out)."""

    rid: int
    lhs: str
    rhs: str
    cond_attr: str | None = None
    op: str | None = None
    cond_val: str | None = None
    from_tid: int | None = None
    to_tid: int | None = None

    @property
    def kind(self) -> str:
        return "CFD" if self.cond_attr else "FD"

    @property
    def attributes(self) -> list[str]:
        return list(dict.fromkeys(a for a in (self.lhs, self.rhs, self.cond_attr) if a))

    @property
    def text(self) -> str:
        """What parse_rule reads."""
        return f"CFD,{self.lhs},{self.rhs},({self.cond_attr} {self.op} {self.cond_val})" if self.cond_attr else f"FD,{self.lhs},{self.rhs}"

    def left(self) -> Column:
        """What tuples are grouped by."""
        return value(self.lhs)

    def right(self) -> Column:
        """What has to agree within a group, and is repaired."""
        return value(self.rhs)

    def condition(self) -> Column:
        """Whether a tuple meets the rule's condition."""
        if not self.cond_attr:
            return F.lit(True)
        c = value(self.cond_attr)
        return c == F.lit(self.cond_val) if self.op == "eq" else (c != F.lit(self.cond_val)) & (c != F.lit(""))

    def sees(self, tid: str = "tid") -> Column:
        """condition() for tuples within the rule's life."""
        out = self.condition()
        if self.from_tid is not None:
            out = out & (F.col(tid) >= self.from_tid)
        if self.to_tid is not None:
            out = out & (F.col(tid) < self.to_tid)
        return out

    def matches(self, row: dict[str, str]) -> bool:
        """condition() for a tuple at hand."""
        if not self.cond_attr:
            return True
        c = row.get(self.cond_attr) or ""
        return c == self.cond_val if self.op == "eq" else c not in (self.cond_val, "")

    def validate(self, columns: Sequence[str]) -> Rule:
        if unknown := [a for a in self.attributes if a not in columns]:
            raise RuleDefinitionError(f"rule {self.rid}: unknown attribute {', '.join(unknown)}")
        return self

    def row(self) -> tuple:
        return (self.rid, self.kind, self.lhs, self.rhs, self.cond_attr, self.op, self.cond_val, self.from_tid, self.to_tid)


def _parse_fd(rid: int, rest: str) -> Rule | None:
    parts = [p.strip() for p in rest.split(",")]
    return Rule(rid, *parts) if len(parts) == 2 and all(parts) else None


def _parse_cfd(rid: int, rest: str) -> Rule | None:
    m = re.fullmatch(r"\s*([^,\s]+)\s*,\s*([^,\s]+)\s*,\s*\(\s*(\S+)\s+(\S+)\s+([^\s,)]+)\s*\)\s*", rest)
    if m and m[4] not in ("eq", "neq"):
        raise RuleDefinitionError(f"rule {rid}: unknown operator {m[4]}")
    return Rule(rid, *m.groups()) if m else None


KINDS: dict[str, Callable[[int, str], Rule | None]] = {"FD": _parse_fd, "CFD": _parse_cfd}


def add_kind(name: str, parse: Callable[[int, str], Rule | None]) -> None:
    """Let parse_rule read `name,...`; parse gets the rule's number and what follows the comma, and gives None where it can't read that."""
    if name in KINDS:
        raise RuleDefinitionError(f"there is a kind {name} already")
    KINDS[name] = parse


def parse_rule(rid: int, text: str) -> Rule:
    kind, _, rest = text.strip().partition(",")
    if kind.strip() not in KINDS:
        raise RuleDefinitionError(f"rule {rid}: unknown kind {kind.strip()}")
    found = KINDS[kind.strip()](rid, rest)
    if found is None:
        raise RuleDefinitionError(f"rule {rid}: can't read {text!r}")
    return found


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([r.row() for r in rules], RULES_SCHEMA)


def intersecting(rules: DataFrame) -> DataFrame:
    """(rid, other_rid) of rules that share a right-hand side."""
    other = rules.select(F.col("rid").alias("other_rid"), F.col("rhs").alias("other_rhs"))
    return rules.join(other, (F.col("rhs") == F.col("other_rhs")) & (F.col("rid") != F.col("other_rid"))).select("rid", "other_rid")


def shares_rhs(rule: Rule, rules: Sequence[Rule]) -> bool:
    return any(r.rid != rule.rid and r.rhs == rule.rhs for r in rules)
