"""Long exact spans of code lines that several files share.

The facts hold each window of ``min_lines`` code lines as one 64-bit hash. A paragraph is a run
of about PARAGRAPH windows that ends where a window's hash says so, so that the same lines are
cut alike in every file. Three stages:

1. MinHash banding. A paragraph's signature has BANDS minima over its set of windows, one a band.
   Paragraphs of different files that collide in a band are linked to one partner, the one they
   collide with in most bands.
2. Verification. The exact Jaccard value of both sets is computed; from JACCARD on, the windows in
   both are shared, each by its whole hash.
3. The rest, exactly. A window that its paragraph's partner doesn't have may still stand in a third
   file, or alone in an otherwise different paragraph, where no banding can be sure to find it. What
   is left after stage 2 is grouped by hash, together with one row for each verified hash.

So no window is lost: ``band_recall`` measures how many of the shared ones stages 1 and 2 find.

Buckets are never expanded into pairs: a bucket is known by its least and greatest paragraph, and
every member meets one of the two. Files linked by shared windows form components.

Defined results: null arrays, null or non-positive min_lines and rows with null ids give no
windows; null hashes inside an array are no window; hash i covers lines i .. i+min_lines-1
of ``lines`` as far as there are any; of copies of a file_id that differ the latest
``collected_at`` counts, if there is such a column; repeats inside one file don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import BROADCAST_ROWS, HOT_SHARE, current, cut, hot_keys, join_small, join_split, sieved

#: Windows of a paragraph on average, bands of its signature (one minimum each), least Jaccard value of linked paragraphs.
PARAGRAPH = 16
BANDS = 4
JACCARD = 0.1

_NIBBLE = np.zeros(256, np.uint64)
_NIBBLE[np.frombuffer(b"0123456789abcdef", np.uint8)] = _NIBBLE[np.frombuffer(b"0123456789ABCDEF", np.uint8)] = np.arange(16)
_SEEDS = [np.uint64(xxhash.xxh64_intdigest(f"band {k}")) for k in range(BANDS)]


def numbers(hashes: pa.Array) -> np.ndarray:
    """Window hashes as numbers: sixteen hexadecimal digits as they are, other texts hashed."""
    usual = pc.match_substring_regex(hashes, "^[0-9a-fA-F]{16}$").to_numpy(zero_copy_only=False)
    out = np.zeros(len(hashes), np.uint64)
    digits = np.frombuffer("".join(hashes.filter(pa.array(usual)).to_pylist()).encode(), np.uint8).reshape(-1, 16)
    value = np.zeros(len(digits), np.uint64)
    for k in range(16):
        value = value << np.uint64(4) | _NIBBLE[digits[:, k]]
    out[usual] = value
    for k in np.flatnonzero(~usual):
        out[k] = xxhash.xxh64_intdigest(hashes[int(k)].as_py())
    return out


def mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_OUT = pa.schema([("file_id", pa.int64()), ("at", pa.int32()), ("w", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column(1).flatten()
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        file_id = np.repeat(batch.column(0).to_numpy(), sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        place = np.arange(len(hashes)) - np.repeat(starts, sizes)
        there = hashes.is_valid().to_numpy(zero_copy_only=False)
        h = numbers(hashes.filter(pa.array(there)).cast(pa.string()))
        file_id, place = file_id[there], place[there]
        if not len(h):
            continue
        # a new row of the table, windows left out between, or a window that says so
        row = np.repeat(np.arange(len(sizes)), sizes)[there]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1) | (mixed(h[1:], np.uint64(1)) % np.uint64(PARAGRAPH) == 0)]))
        ends = np.concatenate([first, [len(h)]]).astype(np.int32)
        bands = np.stack([np.minimum.reduceat(mixed(h, s), first) ^ s for s in _SEEDS], axis=1)
        lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(file_id[first]), pa.array(place[first].astype(np.int32)), lists(h.view(np.int64), ends),
                lists(bands.reshape(-1).view(np.int64), np.arange(len(first) + 1, dtype=np.int32) * BANDS),
            ],
            schema=_OUT,
        )


def usable(facts: DataFrame) -> DataFrame:
    """(file_id, min_lines, lines, hashes) of the files that have facts, copies that a later one replaces left out."""
    at = F.col("collected_at") if "collected_at" in facts.columns else F.lit(0)
    rows = facts.filter("file_id is not null and hashes is not null and lines is not null and min_lines > 0")
    rows = rows.select(F.col("file_id").cast("long").alias("file_id"), "min_lines", "lines", "hashes", at.alias("_order"))
    return current(rows, "file_id", "_order", ["min_lines", "lines", "hashes"]).drop("_order")


def paragraphs(facts: DataFrame) -> DataFrame:
    """(file_id, at, w, bands): one row per paragraph, the place of its first window, its window hashes, and its signature."""
    return facts.select("file_id", "hashes").mapInArrow(_cut, "file_id long, at int, w array<long>, bands array<long>")


def in_buckets(rows: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """Rows with their bucket; hot buckets (``n`` says how many rows each holds) apart from the rest."""
    size = buckets.agg((F.coalesce(F.sum("n"), F.lit(0)) / HOT_SHARE).alias("x"), F.count("*").alias("c")).first()
    if size.c <= BROADCAST_ROWS:
        return rows.join(F.broadcast(buckets.drop("n")), key)
    return join_split(sieved(rows, buckets, [key]), buckets.drop("n"), [key], "inner", buckets.filter(F.col("n") > size.x).select(key))


def linked(paras: DataFrame) -> DataFrame:
    """(file_id, at, partner): the paragraphs that collide with one of another file, each with one partner."""
    bands = paras.select("file_id", "at", F.explode("bands").alias("b"))
    place = F.struct("file_id", "at")
    buckets = cut(bands.groupBy("b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first.file_id < last.file_id"))
    met = in_buckets(bands, buckets, "b").select("file_id", "at", F.when(F.col("file_id") == F.col("first.file_id"), F.col("last")).otherwise(F.col("first")).alias("q"))
    # at most BANDS of them
    per = met.groupBy("file_id", "at").agg(F.collect_list("q").alias("q"))
    often = F.transform(F.array_distinct("q"), lambda x: F.struct(F.size(F.filter("q", lambda y: y == x)).alias("n"), x.alias("q")))
    return per.select("file_id", "at", F.array_max(often)["q"].alias("partner"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)


def verified(paras: DataFrame) -> DataFrame:
    """(file_id, at, w, partner_file, shared): every paragraph with the windows that its partner has too."""
    links = cut(linked(paras))
    own = paras.join(links, ["file_id", "at"], "left").select("file_id", "at", "w", "partner")
    # a partner may be that of any part of all paragraphs
    many = links.groupBy("partner").agg(F.count("*").alias("n"))
    size = many.agg((F.coalesce(F.sum("n"), F.lit(0)) / HOT_SHARE).alias("x")).first().x
    other = join_small(paras.select(F.struct("file_id", "at").alias("partner"), F.col("w").alias("pw")).dropDuplicates(["partner"]), many.select("partner"), ["partner"], "left_semi", even=True)
    both = join_small(own, cut(other), ["partner"], "left", hot=many.filter(F.col("n") > size).select("partner"))
    near = F.coalesce(jaccard("w", "pw") >= JACCARD, F.lit(False))
    return both.select("file_id", "at", "w", F.col("partner.file_id").alias("partner_file"), F.when(near, F.array_intersect("w", "pw")).otherwise(F.array().cast("array<long>")).alias("shared"))


def _places(seen: bool) -> Column:
    """(h, pos) of the windows that are in ``shared``, or of those that aren't."""
    z = F.transform("w", lambda h, k: F.struct(h.alias("h"), (F.col("at") + k).alias("pos")))
    return F.filter(z, lambda x: F.array_contains("shared", x["h"]) == F.lit(seen))


def by_bands(done: DataFrame) -> DataFrame:
    """(file_id, pos, first_file): the shared windows that stages 1 and 2 found; first_file also has them."""
    return done.filter(F.size("shared") > 0).select("file_id", F.explode(_places(True)).alias("x"), F.col("partner_file").alias("first_file")).select("file_id", "x.pos", "first_file")


def left_over(done: DataFrame) -> DataFrame:
    """(file_id, pos, h): the windows that they didn't."""
    return done.select("file_id", F.explode(_places(False)).alias("x")).select("file_id", "x.pos", "x.h")


def holders(done: DataFrame) -> DataFrame:
    """(h, low, high, n): files that hold a hash: one row (n = 1) a window left over, one (n = 0) a verified pair."""
    pairs = done.select("file_id", "partner_file", F.explode("shared").alias("h")).select("h", F.least("file_id", "partner_file").alias("low"), F.greatest("file_id", "partner_file").alias("high"), F.lit(0).alias("n"))
    return left_over(done).select("h", F.col("file_id").alias("low"), F.col("file_id").alias("high"), F.lit(1).alias("n")).unionByName(pairs)


def by_hash(held: DataFrame) -> DataFrame:
    """(h, first_file, n, rows): hashes in two files at least, how many windows left over have them, and how many rows."""
    return held.groupBy("h").agg(F.min("low").alias("first_file"), F.max("high").alias("last_file"), F.sum("n").alias("n"), F.count("*").alias("rows")).filter("first_file < last_file").drop("last_file")


def the_rest(done: DataFrame) -> DataFrame:
    """(file_id, pos, first_file): the shared windows among those left over."""
    return in_buckets(left_over(done), cut(by_hash(holders(done)).filter("n > 0").drop("rows")), "h").select("file_id", "pos", "first_file")


def shared_windows(facts: DataFrame) -> DataFrame:
    """(file_id, pos, first_file): every window that another file has too."""
    done = cut(verified(cut(paragraphs(usable(facts)))))
    return by_bands(done).unionByName(the_rest(done))


def band_recall(facts: DataFrame) -> DataFrame:
    """(by_bands, all, recall): shared windows that banding finds before the exact stage."""
    done = cut(verified(cut(paragraphs(usable(facts)))))
    a, b = by_bands(done).agg(F.count("*").alias("by_bands")), the_rest(done).agg(F.count("*").alias("rest"))
    return a.join(F.broadcast(b)).select("by_bands", (F.col("by_bands") + F.col("rest")).alias("all"), F.when(F.col("by_bands") + F.col("rest") > 0, F.col("by_bands") / (F.col("by_bands") + F.col("rest"))).otherwise(1.0).alias("recall"))


def shared_lines(facts: DataFrame) -> DataFrame:
    """(file_id, lines array<int>): the distinct shared code lines of each file that has any."""
    places = shared_windows(facts).groupBy("file_id").agg(F.collect_set("pos").alias("places"))
    whole = usable(facts).select("file_id", "lines", "min_lines")
    cover = F.array_distinct(F.flatten(F.transform("places", lambda p: F.slice(F.col("lines"), p + 1, F.col("min_lines")))))
    return whole.join(places, "file_id").select("file_id", cover.alias("lines")).dropDuplicates(["file_id"])


def line_rows(shared: DataFrame) -> DataFrame:
    return shared.select("file_id", F.explode("lines").alias("line")).filter("line is not null")


def shares(facts: DataFrame) -> DataFrame:
    """(file_id, code_lines, shared_lines, share) of every file that has facts."""
    every = facts.filter("file_id is not null and lines is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.max(F.size("lines")).alias("code_lines"))
    some = shared_lines(facts).select("file_id", F.size("lines").alias("shared_lines"))
    out = every.join(some, "file_id", "left").withColumn("shared_lines", F.coalesce("shared_lines", F.lit(0)))
    return out.withColumn("share", F.when(F.col("code_lines") > 0, F.col("shared_lines") / F.col("code_lines")).otherwise(0.0))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of (a, b) edges; the least id names them.

    Each round moves every id to the least label among its neighbours and then to that
    label's own label, so the rounds grow with the logarithm of the diameter. Labels are
    written to the shared folder after each round."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hubs = cut(hot_keys(both, ["b"]))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = join_small(both, labels.select(F.col("id").alias("b"), "component"), ["b"], hot=hubs).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = cut(labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was")))
        # a label may be that of any part of all ids
        new = cut(join_small(moved, moved.select(F.col("id").alias("to"), F.col("to").alias("next")), ["to"], "left").select("id", F.least("to", F.coalesce("next", "to")).alias("component"), "was"))
        if new.filter("component != was").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def file_links(done: DataFrame) -> DataFrame:
    """(a, b): links that connect all files of each shared hash, through the least of them."""
    held = holders(done).drop("n")
    met = in_buckets(held, cut(by_hash(holders(done)).drop("n").withColumnRenamed("rows", "n")), "h")
    return met.select(F.explode(F.array("low", "high")).alias("a"), F.col("first_file").alias("b")).filter("a != b").distinct()


def file_components(facts: DataFrame) -> DataFrame:
    """(file_id, component): files linked by shared spans."""
    return components(file_links(cut(verified(cut(paragraphs(usable(facts))))))).withColumnRenamed("id", "file_id")
