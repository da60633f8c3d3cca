"""Configuration from a properties file: `key=value` lines, `#` comments, a backslash escapes.

Keys of a job begin with a prefix: `<prefix>.schema`, `.window`, `.window.size`, `.topology.rw`,
`.topology.name`, `.repair.proposal.size`, `.rule.num`, `.rule.<i>`, `.input`, `.output`. Those of the
connector have none: `kafka.topic`, `kafka.control.topic`, `kafka.server`, `kafka.server.port`,
`kafka.data.delimiter`. All others are kept in `other` and mean nothing here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import ConfigError
from ..functions.rules import Rule, parse_rule

REPAIR_MODES = {"1": "delayed", "2": "immediate", "3": "delayed"}


@dataclass
class Config:
    columns: list[str]
    rules: list[Rule] = field(default_factory=list)
    mode: str = "none"
    window_step: int | None = None
    repair_mode: str = "delayed"
    separator: str = r"\|"
    proposal_size: int = 5
    input: str | None = None
    output: str | None = None
    topic: str | None = None
    control_topic: str | None = None
    servers: str | None = None
    other: dict[str, str] = field(default_factory=dict)


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            key, _, val = line.partition("=")
            out[key.strip()] = re.sub(r"\\(.)", r"\1", val.strip())
    return out


def parse_config(text: str, prefix: str | None = None) -> Config:
    """prefix: of the job's keys; by default that of the key `<prefix>.schema`. The window is `false`, `basic`, or `cumulative` (also written as the prefix); its size is the step by which it slides."""
    whole = parse_properties(text)
    if prefix is None:
        found = [k.removesuffix(".schema") for k in whole if k.endswith(".schema")]
        if len(found) != 1:
            raise ConfigError("no schema" if not found else f"several schemas: {', '.join(found)}")
        prefix = found[0]
    own = {k.removeprefix(f"{prefix}."): v for k, v in whole.items() if k.startswith(f"{prefix}.")}
    if "schema" not in own:
        raise ConfigError("no schema")
    window = own.get("window", "false").lower()
    mode = {"false": "none", "basic": "basic", "cumulative": "cumulative", prefix.lower(): "cumulative"}.get(window)
    if mode is None:
        raise ConfigError(f"unknown window mode {window}")
    step = whole_number(own, "window.size") if mode != "none" and "window.size" in own else None
    if mode != "none" and not step:
        raise ConfigError("a window needs a size")
    out = Config([c.strip() for c in own["schema"].split(",")], mode=mode, window_step=step)
    numbers = sorted(int(m[1]) for k in own if (m := re.fullmatch(r"rule\.(\d+)", k)))
    if "rule.num" in own:
        n = whole_number(own, "rule.num")
        if missing := [i for i in range(n) if i not in numbers]:
            raise ConfigError(f"no rule {missing[0]} of {n}")
        numbers = list(range(n))
    out.rules = [parse_rule(i, own[f"rule.{i}"]).validate(out.columns) for i in numbers]
    rw = own.get("topology.rw", "3")
    if rw not in REPAIR_MODES:
        raise ConfigError(f"unknown repair mode {rw}")
    out.repair_mode = REPAIR_MODES[rw]
    out.separator = whole.get("kafka.data.delimiter", out.separator)
    out.proposal_size = whole_number(own, "repair.proposal.size") if "repair.proposal.size" in own else out.proposal_size
    out.input, out.output = own.get("input"), own.get("output")
    out.topic, out.control_topic = whole.get("kafka.topic"), whole.get("kafka.control.topic")
    if "kafka.server" in whole:
        out.servers = f"{whole['kafka.server']}:{whole.get('kafka.server.port', '9092')}"
    out.other = whole
    return out


def whole_number(p: dict[str, str], key: str) -> int:
    try:
        return int(p[key])
    except ValueError:
        raise ConfigError(f"{key} is not a whole number: {p[key]}") from None
