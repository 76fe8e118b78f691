"""Duplicated code across a whole project, by hashes of line windows.

A file's facts (kept line numbers and window hashes) are computed inside its own row
with higher-order functions: nothing is shuffled before the hashes. A hash that occurs
more than ``max_occurrences`` times is boilerplate by definition and is dropped before
occurrences are gathered, so a group never holds more than that many rows. Pairs on one
diagonal are merged into maximal runs by gaps and islands.

Defined results: null or empty texts, texts with NUL and files without a language have no
facts; a text with fewer kept lines than ``min_lines`` has no windows; equal files give one
pair per occurrence up to the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.cluster import kept
from treeline.functions import text as T

# Lines of a window, and occurrences beyond which it is boilerplate.
MIN_LINES = 8
MAX_OCCURRENCES = 10


def kept_lines(source: Column) -> Column:
    """array<struct<line, norm>>: lines with a letter or number that aren't imports, without white space."""
    numbered = F.transform(T.lines(source), lambda x, i: F.struct((i + 1).cast("int").alias("line"), T.without_space(x).alias("norm"), (T.has_letter(x) & ~T.is_import(x)).alias("keep")))
    return F.transform(F.filter(numbered, lambda x: x["keep"]), lambda x: F.struct(x["line"].alias("line"), x["norm"].alias("norm")))


def facts(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(file, lines array<int>, hashes array<string>) of files(file, source, language)."""
    usable = files.filter(F.col("language").isNotNull() & F.col("source").isNotNull() & (F.instr("source", "\u0000") == 0))
    k = usable.select("file", kept_lines(F.col("source")).alias("k")).select("file", F.col("k.line").alias("lines"), F.col("k.norm").alias("norm"))
    return k.select("file", "lines", T.window_hashes(F.col("norm"), min_lines).alias("hashes"))


def windows(facts_: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(file, pos, hash, line, last_line)."""
    n = F.size("hashes")
    z = F.arrays_zip(F.col("hashes").alias("hash"), F.slice("lines", 1, n).alias("line"), F.slice("lines", min_lines, n).alias("last_line"))
    return facts_.select("file", F.posexplode(z).alias("pos", "w")).select("file", "pos", "w.hash", "w.line", "w.last_line")


def pairs(w: DataFrame, min_lines: int = MIN_LINES, max_occurrences: int = MAX_OCCURRENCES) -> DataFrame:
    """(a, b, first): two places with one hash, a before b, and the hash's first place.

    Overlaps of a file with itself are left out. Windows are kept while hashes are counted, so that texts are hashed once."""
    w = kept(w.select("hash", "file", "pos", "line", "last_line"))
    good = w.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_occurrences)).select("hash")
    place = F.struct("file", "pos", "line", "last_line")
    groups = w.join(good, "hash", "left_semi").groupBy("hash").agg(F.sort_array(F.collect_list(place)).alias("p"))
    both = groups.select("p", F.posexplode("p").alias("i", "a")).select(F.col("p")[0].alias("first"), "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    return both.filter((F.col("a.file") != F.col("b.file")) | (F.col("b.pos") - F.col("a.pos") >= min_lines))


def runs(p: DataFrame) -> DataFrame:
    """Maximal runs of pairs on one diagonal: spans in both files, and where they were first seen."""
    flat = p.select(F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b"), (F.col("b.pos") - F.col("a.pos")).alias("delta"), F.col("a.pos").alias("pos"), "a", "b", "first")
    w = Window.partitionBy("file_a", "file_b", "delta").orderBy("pos")
    islands = flat.withColumn("island", F.col("pos") - F.row_number().over(w))
    start = F.struct("pos", F.struct(F.struct(F.col("first.file").alias("f"), F.col("first.pos").alias("p")).alias("first"), F.struct(F.col("a.file").alias("f"), F.col("a.pos").alias("p")).alias("a"), F.struct(F.col("b.file").alias("f"), F.col("b.pos").alias("p")).alias("b")).alias("key"))
    return islands.groupBy("file_a", "file_b", "delta", "island").agg(
        F.min("a.line").alias("start_a"), F.max("a.last_line").alias("end_a"), F.min("b.line").alias("start_b"), F.max("b.last_line").alias("end_b"), F.count("*").alias("windows"), F.min(start)["key"].alias("seen")
    )


def locations(r: DataFrame) -> DataFrame:
    """(file, start, end, other, others): one row per distinct place, the place it was first paired with, and with how many."""
    side_a = r.select(F.col("file_a").alias("file"), F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.struct(F.col("file_b").alias("file"), F.col("start_b").alias("start"), F.col("end_b").alias("end")).alias("o"), F.struct("seen", F.lit(0).alias("side")).alias("key"))
    side_b = r.select(F.col("file_b").alias("file"), F.col("start_b").alias("start"), F.col("end_b").alias("end"), F.struct(F.col("file_a").alias("file"), F.col("start_a").alias("start"), F.col("end_a").alias("end")).alias("o"), F.struct("seen", F.lit(1).alias("side")).alias("key"))
    return side_a.unionByName(side_b).groupBy("file", "start", "end").agg(F.min_by("o", "key").alias("other"), F.count_distinct("o").alias("others"), F.min("key").alias("key"))


def findings(loc: DataFrame) -> DataFrame:
    """Duplicate findings with message and end line."""
    more = F.when(F.col("others") > 1, F.concat(F.lit(", +"), (F.col("others") - 1).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    message = F.concat(F.lit("Duplicated code: lines "), F.col("start"), F.lit("-"), F.col("end"), F.lit(" ("), F.col("end") - F.col("start") + 1, F.lit(" lines) repeat "), F.col("other.file"), F.lit(":"), F.col("other.start"), more)
    return loc.select("file", F.col("start").alias("line"), F.lit("duplicate-code").alias("rule"), F.lit("warning").alias("severity"), message.alias("message"), F.col("end").alias("end_line"))


def duplicate_code(files: DataFrame, min_lines: int = MIN_LINES, max_occurrences: int = MAX_OCCURRENCES) -> DataFrame:
    return findings(locations(runs(pairs(windows(facts(files, min_lines), min_lines), min_lines, max_occurrences))))
