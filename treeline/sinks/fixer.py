"""Applying fixes: byte spans replaced from the end of each file to its start."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.operators import post


def splice(content: bytes, fixes: Iterable[tuple[int, int, str]]) -> bytes:
    """Fixes must come from the greatest start to the least and not overlap."""
    for start, end, new in fixes:
        content = content[:start] + new.encode() + content[end:]
    return content


def apply(findings: DataFrame, files: DataFrame) -> int:
    """Writes the fixed files from the executors; returns how many fixes were applied."""
    sizes = files.select("file", F.octet_length("content").alias("size"))
    keyed = findings.filter("fix is not null").withColumn("k", F.struct("phase", "rule_ord", "k1", "k2")).join(sizes, "file")
    chosen = post.select_fixes(keyed.select("file", "fix", "k", "size"), F.col("size"))

    def write(rows: Iterable) -> Iterable[tuple[int]]:
        n = 0
        for r in rows:
            with open(r.file, "rb") as f:
                content = f.read()
            new = splice(content, [(x.start_offset, x.end_offset, x.replacement) for x in r.fixes])
            with open(f"{r.file}.new", "wb") as f:
                f.write(new)
            os.replace(f"{r.file}.new", r.file)
            n += len(r.fixes)
        yield (n,)

    return sum(n for (n,) in chosen.rdd.mapPartitions(write).collect())  # one number a partition
