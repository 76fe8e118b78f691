"""Evaluation passages inside documents, by canonical templates.

Words are runs of letters or digits, compared without case, punctuation, spacing, marks
or invisible characters. A word is a number, a unit, a template word (it occurs in several
items) or a name; templates keep template words and put a typed placeholder for the rest.
Windows of 12 template places are hashed on both sides and joined; then the slots decide:
if every slot holds the same value the passage is verbatim, if the values differ but map
one to one the question was re-parameterised.

A template has at most MOST_DIFFERENT slots, so that windows of rare words alone don't all
meet: for verbatim passages the words beyond count as written, for reworded ones the window
has a key for each of its slots, with that slot's value (one of them at least must be equal).

Template words and item windows are known by bitmaps of fixed size, so what is broadcast
doesn't grow with items or documents. A word taken for a template word by chance is one on
both sides.

Defined results: null or empty texts have no windows, as have texts under 12 words; rows
with null ids are left out; a document that repeats a passage counts once per item; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.cluster import BROADCAST_ROWS, cut, join_small
from treeline.llm.bits import Bits

WINDOW = 12
#: Bits of the bitmaps of item windows and of template words; items in which a template word occurs at least.
BITS = 1 << 23
WORD_BITS = 1 << 22
TEMPLATE_ITEMS = 3
#: Most slots of a reworded window that hold other values than the item's, and of any template.
MOST_DIFFERENT = WINDOW // 2

# Units of measure that stand for each other in re-parameterised questions.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes hour hours day days kb mb gb tb byte bytes bit bits px cm mm m km kg g mg percent usd eur".split())

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
_LIST_NUMBER = re.compile(r"(?m)^[ \t>*#/-]*\d{1,3}[.)][ \t]+")
_WORD = re.compile(r"[^\W_]+")
_HASHES: dict[str, tuple[int, int]] = {}
#: What stands for a number, a unit, a name.
NUMBER, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest("\0" + x)) for x in ("number", "unit", "name"))


def words(text: str) -> list[str]:
    """The canonical words of a text, in order."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _WORD.findall(_LIST_NUMBER.sub(" ", text).casefold())


def _known(word: str) -> tuple[int, int]:
    """(hash, kind) of a word; kind is 1 for a number, 2 for a unit."""
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[word] = xxhash.xxh64_intdigest(word), 1 if word.isdigit() else 2 if word in UNITS else 0
    return h


def hashed(w: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, kind) of every word."""
    got = np.array([_known(x) for x in w], dtype=np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(got[:, 0]), got[:, 1]


WORD_SHIFTS, KEY_SHIFTS = (9, 37), (17,)


def rolling(values: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """A hash of every run of WINDOW values; ``values(k)`` has the k-th of each of the ``n`` runs."""
    out = np.zeros(n, np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out = (out ^ (out >> np.uint64(31))) * m + values(k)
    return out


class Windows:
    """All windows of one text."""

    def __init__(self, text: str, template: Bits) -> None:
        w = words(text)
        self.n = n = max(0, len(w) - WINDOW + 1)
        if n:
            self.word, kind = hashed(w)
            self.slot = (kind > 0) | ~template.has(self.word)
            self.canon = np.where(kind == 1, NUMBER, np.where(kind == 2, UNIT, np.where(self.slot, NAME, self.word)))
            self.before = np.concatenate([[0], np.cumsum(self.slot)])

    def template(self) -> np.ndarray:
        """Hash of each window's template; slots after the MOST_DIFFERENT first count as written."""
        start = self.before[: self.n]

        def value(k: int) -> np.ndarray:
            beyond = self.slot[k : k + self.n] & (self.before[k : k + self.n] - start >= MOST_DIFFERENT)
            return np.where(beyond, self.word[k : k + self.n], self.canon[k : k + self.n])

        return rolling(value, self.n)

    def plain(self) -> np.ndarray:
        return rolling(lambda k: self.word[k : k + self.n], self.n)

    def verbatim_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, key): one a window."""
        return np.arange(self.n), self.template()

    def reworded_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, key): the template's hash alone, or with each slot's value where there are more than MOST_DIFFERENT."""
        shape = rolling(lambda k: self.canon[k : k + self.n], self.n)
        many = self.before[WINDOW : WINDOW + self.n] - self.before[: self.n] > MOST_DIFFERENT
        at, key = [np.flatnonzero(~many)], [shape[~many]]
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                where = np.flatnonzero(many & self.slot[k : k + self.n])
                mixed = (shape[where] ^ self.word[where + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
                at.append(where)
                key.append(mixed ^ (mixed >> np.uint64(29)))
        return np.concatenate(at), np.concatenate(key)

    def slots(self, at: int) -> np.ndarray:
        """Hashes of the values in a window's slots, in order."""
        return self.word[at : at + WINDOW][self.slot[at : at + WINDOW]].view(np.int64)


def _emit(batches: Iterator[pd.DataFrame], template: Bits, known: Bits | None, reworded: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for ident, text in zip(pdf["id"], pdf["text"]):
            win = Windows(text, template) if text else None
            if win is None or not win.n:
                continue
            at, key = win.reworded_keys() if reworded else win.verbatim_keys()
            if known is not None:
                held = known.has(key)
                at, key = at[held], key[held]
            if len(at):
                plain = win.plain().view(np.int64)
                rows += [(ident, j, int(plain[k]), win.slots(k)) for k, j in zip(at.tolist(), key.view(np.int64).tolist())]
        yield pd.DataFrame(rows, columns=["id", "key", "plain", "slots"])


SCHEMA = "id long, key long, plain long, slots array<long>"


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, x) for i, t in zip(pdf["id"], pdf["text"]) if t for x in np.unique(hashed(words(t))[0]).view(np.int64).tolist()]
        yield pd.DataFrame(rows, columns=["id", "h"])


def template_words(items: DataFrame) -> Bits:
    """Words of at least TEMPLATE_ITEMS items."""
    per = items.mapInPandas(_words_of, "id long, h long").groupBy("h").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= TEMPLATE_ITEMS)
    return Bits.of(per, WORD_BITS, WORD_SHIFTS)


def _pair(df: DataFrame, ident: str) -> DataFrame:
    return df.select(F.col(ident).cast("long").alias("id"), F.col("text").cast("string").alias("text")).filter("id is not null and text is not null")


def candidates(documents: DataFrame, items: DataFrame, reworded: bool) -> tuple[DataFrame, DataFrame]:
    """(windows of documents whose key some item has, windows of items).

    A key may be in any part of all documents, but in few items."""
    items = _pair(items, "item_id")
    template = template_words(items)
    # the same window may stand in many items; each (item, window) once
    held = cut(items.mapInPandas(lambda it: _emit(it, template, None, reworded), SCHEMA).dropDuplicates(["id", "plain", "key"]))
    known = Bits.of(held.select(F.col("key").alias("h")), BITS, KEY_SHIFTS)
    shared = items.sparkSession.sparkContext.broadcast((template, known))
    found = _pair(documents, "doc_id").mapInPandas(lambda it: _emit(it, *shared.value, reworded), SCHEMA).withColumnRenamed("id", "doc_id")
    if held.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        found = cut(found)  # its keys are counted before it is joined
    return found, held.select(F.col("id").alias("item_id"), "key", F.col("plain").alias("item_plain"), F.col("slots").alias("item_slots"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds WINDOW consecutive words of the item.

    Template windows are joined, and all slots must hold the same values."""
    return join_small(*candidates(documents, items, False), ["key"]).filter(F.col("slots") == F.col("item_slots")).select("doc_id", "item_id").distinct()


def reworded_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, places): template windows whose slots differ, at most MOST_DIFFERENT of them, but map one to one.

    Windows that are verbatim in any item are left out before the join."""
    found, held = candidates(documents, items, True)
    # what is verbatim in one item isn't another one reworded
    fresh = join_small(found, held.select(F.col("item_plain").alias("plain")).distinct(), ["plain"], "left_anti")
    z = F.arrays_zip("slots", "item_slots")
    one_to_one = (F.size(F.array_distinct(z)) == F.size(F.array_distinct("slots"))) & (F.size(F.array_distinct("slots")) == F.size(F.array_distinct("item_slots")))
    few = F.size(F.filter(z, lambda x: x["slots"] != x["item_slots"])) <= MOST_DIFFERENT
    good = join_small(fresh, held, ["key"]).filter((F.size("slots") == F.size("item_slots")) & few & one_to_one)
    return good.groupBy("doc_id", "item_id").agg(F.count_distinct("plain").alias("places"))


def item_report(found: DataFrame) -> DataFrame:
    """(item_id, documents): how many documents leak each item."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"))
