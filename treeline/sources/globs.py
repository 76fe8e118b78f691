"""Path filters: skipped directories and exclude globs.

A pattern without '/' matches any one segment of the path; one with '/' matches any
prefix of it. ``*`` and ``?`` stay inside a segment, ``**`` doesn't.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never looked into.
SKIPPED = (".git", ".claude", "vendor", "node_modules", "data", "dist", "build", "target", "out", "var")


def skipped(path: Column) -> Column:
    """Whether a path relative to the scanned root lies in a skipped directory."""
    names = "|".join(re.escape(d) for d in SKIPPED)
    return F.concat(F.lit("/"), path).rlike(rf"/(?:{names})/")


def plain(pattern: str) -> str:
    p = pattern.replace("\\", "/")
    if p.startswith("./"):
        p = p[2:]
    return p.strip("/")


_GLOB = re.compile(r"(?P<dirs>\*\*/)|(?P<any>\*\*)|(?P<part>\*)|(?P<one>\?)|[^*?]+")
# What each wild card stands for.
_WILD = {"dirs": "(?:.*/)?", "any": ".*", "part": "[^/]*", "one": "[^/]"}


def to_regex(pattern: str) -> str:
    """A glob as a regular expression that Java and Python read alike."""
    return _GLOB.sub(lambda m: _WILD[m.lastgroup] if m.lastgroup else re.escape(m.group()), plain(pattern))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern excludes the path (relative, with '/')."""
    out = F.lit(False)
    for pattern in patterns:
        p = plain(pattern)
        if not p:
            continue
        # a segment, or a prefix that ends where a segment ends
        rx = f"(?:^|/){to_regex(p)}(?:/|$)" if "/" not in p else f"^{to_regex(p)}(?:/|$)"
        out = out | path.rlike(rx)
    return out


def is_excluded(path: str, patterns: list[str]) -> bool:
    """The same for one path on the driver."""
    for pattern in patterns:
        p = plain(pattern)
        if p and re.search(f"(?:^|/){to_regex(p)}(?:/|$)" if "/" not in p else f"^{to_regex(p)}(?:/|$)", path):
            return True
    return False
