"""Text functions as column expressions: lines, counts, hashes, escapes, paths.

Every function stays inside the JVM. Nulls give null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lines that only import or declare a namespace.
IMPORT_LINE = (
    r"^\s*(?:<\?php|use|import|using|package|namespace|from\s+\S+\s+import|#\s*(?:include|import)|require(?:_once)?|include(?:_once)?|extern\s+crate|@import)(?![A-Za-z0-9_])"
)
TRIMMED = " \t\n\r\u0000\u000b"


def lines(text: Column) -> Column:
    """All lines, split at LF; an empty text has one empty line."""
    return F.split(text, "\n")


def lines_of_code(text: Column) -> Column:
    """Lines with more than white space; 0 for a text with NUL."""
    return F.when(F.instr(text, "\u0000") > 0, 0).otherwise(F.regexp_count(text, F.lit(r"(?md)^[ \t]*\S")))


def without_space(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+", "")


def is_import(line: Column) -> Column:
    return line.rlike(IMPORT_LINE)


def has_letter(line: Column) -> Column:
    """A letter or number of any script."""
    return line.rlike(r"[\p{L}\p{N}]")


def window_hashes(norm: Column, size: int) -> Column:
    """16 hexadecimal digits over each ``size`` consecutive normalised lines; no window for fewer lines.

    Shifted copies of the array are zipped, so that the cost a window doesn't grow with the text."""
    n = F.size(norm) - size + 1
    z = F.arrays_zip(*[F.slice(norm, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(size)])
    return F.transform(z, lambda x: F.substring(F.md5(F.concat_ws("\n", *[x[f"w{k}"] for k in range(size)])), 1, 16))


def cache_key(file: Column, content: Column) -> Column:
    return F.sha1(F.concat(F.encode(file, "UTF-8"), F.unhex(F.lit("00")), F.encode(F.sha1(content), "UTF-8")))


def first_non_ascii_line(text: Column) -> Column:
    """1-based; 0 when there is none."""
    return F.array_position(F.transform(lines(text), lambda x: x.rlike(r"[^\x00-\x7F]")), True)


def has_bom(content: Column) -> Column:
    return F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./]*)$", 1))


def relative(path: Column, base: str) -> Column:
    """The path below ``base``, with '/'; other paths stay as they are."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = base.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)


def escape_data(text: Column) -> Column:
    """For the message of a CI annotation."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(text: Column) -> Column:
    return F.replace(F.replace(escape_data(text), F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C"))


def escape_uri(text: Column) -> Column:
    """Per cent encoding of a path segment (RFC 3986)."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def language_of(file: Column, names: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The first language one of whose extensions the path ends with; case counts."""
    out = F.lit(None).cast("string")
    for name, exts in reversed(names):
        cond = F.lit(False)
        for e in exts:
            cond = cond | F.endswith(file, F.lit(e))
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def severity_level(severity: Column, kind: str) -> Column:
    """How a format names a severity: ``annotation`` or ``sarif``, or its rank."""
    names = {"annotation": ("error", "warning", "notice"), "sarif": ("error", "warning", "note"), "rank": ("3", "2", "1")}[kind]
    return F.create_map(*[F.lit(x) for pair in zip(("error", "warning", "info"), names) for x in pair])[severity]


def fixed(text: str) -> str:
    """A literal text as a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)
