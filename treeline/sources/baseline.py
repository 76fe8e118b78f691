"""Baselines as JSON files: known findings that aren't reported again."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from treeline.sources.config import ConfigError

VERSION = 1
SCHEMA = "file string, rule string, message string, count long"


def entries(raw: object) -> list[tuple[str, str, str, int]]:
    """(file, rule, message, count) of decoded JSON. Raises ConfigError on a wrong shape."""
    if not isinstance(raw, dict) or not isinstance(raw.get("findings"), list):
        raise ConfigError("a baseline must have a list of findings")
    out = []
    for e in raw["findings"]:
        if not isinstance(e, dict) or not all(isinstance(e.get(k), str) for k in ("file", "rule", "message")):
            raise ConfigError("a baseline entry must have file, rule and message")
        n = e.get("count", 1)
        if not isinstance(n, int) or isinstance(n, bool):
            raise ConfigError("a baseline count must be a number")
        out.append((e["file"], e["rule"], e["message"], n))
    return out


def load(spark: SparkSession, path: str, must_exist: bool = True) -> DataFrame:
    if not must_exist and not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    try:
        with open(path, encoding="utf-8") as f:
            rows = entries(json.load(f))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return spark.createDataFrame(rows, SCHEMA)


def save(baseline: DataFrame, path: str) -> int:
    """Writes the baseline, sorted by key; returns how many entries it has."""
    rows = baseline.orderBy("file", "rule", "message").toLocalIterator()
    found = [{"file": r.file, "rule": r.rule, "message": r.message, "count": r["count"]} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "findings": found}, f, ensure_ascii=False, indent=4)
        f.write("\n")
    return len(found)
