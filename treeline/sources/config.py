"""The project configuration: discovered upwards, validated on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

SEVERITIES = ("error", "warning", "info")
NAMES = ("treeline.json", ".treeline.json")
KEYS = ("rules", "exclude", "baseline", "$schema")


class ConfigError(ValueError):
    """The configuration, or something the command line names, is not usable."""


@dataclass(frozen=True)
class Config:
    """Severities (None: off), options per rule, exclude globs, and the baseline's path."""

    base_dir: str = "."
    severities: dict[str, str | None] = field(default_factory=dict)
    options: dict[str, dict[str, int]] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    baseline: str | None = None
    source: str | None = None

    def disabled(self, rule: str) -> bool:
        return rule in self.severities and self.severities[rule] is None


def discover(path: str) -> str | None:
    """The nearest configuration file at or above the analysed path."""
    here = os.path.abspath(path)
    here = here if os.path.isdir(here) else os.path.dirname(here)
    while True:
        for name in NAMES:
            if os.path.isfile(p := os.path.join(here, name)):
                return p
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up


def _severity(rule: str, value: object) -> str | None:
    if value == "off":
        return None
    if value not in SEVERITIES:
        raise ConfigError(f"{rule}: severity must be one of error, warning, info, off")
    return str(value)


def read(raw: object, base_dir: str, source: str | None = None) -> Config:
    """A configuration from decoded JSON. Raises ConfigError."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be an object")
    for key in raw:
        if key not in KEYS:
            raise ConfigError(f"unknown key {key!r}")
    rules = raw.get("rules", {})
    if not isinstance(rules, dict):
        raise ConfigError("rules must be an object")
    severities: dict[str, str | None] = {}
    options: dict[str, dict[str, int]] = {}
    for rule, value in rules.items():
        if isinstance(value, dict):
            if "severity" in value:
                severities[rule] = _severity(rule, value["severity"])
            own = {k: v for k, v in value.items() if k != "severity"}
            if own:
                options[rule] = own
        else:
            severities[rule] = _severity(rule, value)
    exclude = raw.get("exclude", [])
    if not isinstance(exclude, list) or not all(isinstance(x, str) and x.strip() for x in exclude):
        raise ConfigError("exclude must be a list of patterns")
    baseline = raw.get("baseline")
    if baseline is not None:
        if not isinstance(baseline, str) or not baseline.strip():
            raise ConfigError("baseline must be a path")
        baseline = baseline if os.path.isabs(baseline) else os.path.join(base_dir, baseline)
    return Config(base_dir, severities, options, tuple(exclude), baseline, source)


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return read(raw, os.path.dirname(os.path.abspath(path)), path)
