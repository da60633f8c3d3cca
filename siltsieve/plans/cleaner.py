"""The front end: rules and a window in, DataFrames out, in batch and in streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.rules import Rule
from ..functions.shared import cut
from ..operators import classes, repair
from ..operators.detect import clean, detect_all
from .config import parse_config

if TYPE_CHECKING:
    from ..streaming.live import LiveCleaner


@dataclass
class Cleaner:
    """rules are checked against each input; mode: none, basic or cumulative; step: half of the window in tuples."""

    rules: Sequence[Rule]
    mode: str = "none"
    step: int | None = None
    repair_mode: str = "delayed"
    columns: list[str] = field(default_factory=list)

    @classmethod
    def from_config(cls, text: str, prefix: str | None = None) -> Cleaner:
        c = parse_config(text, prefix)
        return cls(c.rules, c.mode, c.window_step, c.repair_mode, c.columns)

    def _check(self, df: DataFrame) -> None:
        for r in self.rules:
            r.validate(df.columns)

    def detect(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return detect_all(df, self.rules, self.step)

    def clean(self, df: DataFrame) -> DataFrame:
        return clean(df, self.detect(df))

    def fixes(self, df: DataFrame) -> DataFrame:
        """(kid, attr, fix): on arrival for right-hand sides of one rule, as classes stand at the end (with a window: of its pane) for those of several."""
        self._check(df)
        by: dict[str, list[Rule]] = {}
        for r in self.rules:
            by.setdefault(r.rhs, []).append(r)
        if len(self.rules) > 1:
            df = cut(df.select("kid", "tid", *[c for c in dict.fromkeys(a for r in self.rules for a in r.attributes) if c not in ("kid", "tid")]))
        out = None
        for attr, own in by.items():
            if len(own) == 1:
                one = repair.repair_rule(df, own[0], self.mode, self.step).where("violating").select("kid", "fix")
            elif self.mode != "none":
                one = classes.repair_shared_windows(df, own, self.mode, self.step)
            else:
                one = classes.repair_shared(df, own)
            one = one.withColumn("attr", F.lit(attr))
            out = one if out is None else out.unionByName(one)
        return out.select("kid", "attr", "fix")

    def repair(self, df: DataFrame) -> DataFrame:
        """df with repaired values, and repaired (some attribute violated) and changed (some value is another), which replace columns of these names."""
        if not self.rules:
            return df.withColumns({"repaired": F.lit(False), "changed": F.lit(False)})
        found = self.fixes(df)
        attrs = list(dict.fromkeys(r.rhs for r in self.rules))
        wide = found.groupBy("kid").agg(*[F.max(F.when(F.col("attr") == a, F.col("fix"))).alias(f"__fix_{i}") for i, a in enumerate(attrs)])
        out = df.join(wide, "kid", "left")
        fix = [F.col(f"__fix_{i}") for i in range(len(attrs))]
        changed = [F.coalesce(f != F.coalesce(F.col(a).cast("string"), F.lit("")), F.lit(False)) for f, a in zip(fix, attrs, strict=True)]
        flags = {"repaired": F.coalesce(*fix).isNotNull(), "changed": F.greatest(*changed) if len(changed) > 1 else changed[0]}
        new = {a: F.coalesce(f, F.col(a).cast("string")) for f, a in zip(fix, attrs, strict=True)}
        return out.select(*[new[c].alias(c) if c in new else c for c in df.columns if c not in flags], *[f.alias(c) for c, f in flags.items()])

    def repair_stream(self, sdf: DataFrame) -> DataFrame:
        from ..streaming.stateful import repair_stream

        self._check(sdf)
        return repair_stream(sdf, self.rules, self.mode, self.step, self.repair_mode)

    def can_live(self) -> bool:
        """Whether a LiveCleaner does what these rules and modes ask for: all but windows on right-hand sides of several rules, and immediate repair of these."""
        shared = len({r.rhs for r in self.rules}) < len(self.rules)
        return not shared or (self.mode == "none" and self.repair_mode == "delayed")

    def live(self, spark: SparkSession, place: str) -> LiveCleaner:
        """For a stream of tuples with rules that may change; see streaming.live."""
        from ..streaming.live import LiveCleaner

        if not self.can_live():
            raise ConfigError("use repair_stream for windows or immediate repair on right-hand sides of several rules")
        return LiveCleaner(spark, self.rules, place, self.mode, self.step)
