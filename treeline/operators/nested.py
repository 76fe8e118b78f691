"""Nested JSON trees as flat tables with interval labels.

Each tree is walked once, depth first and without recursion; every node gets its
pre-order number, the last pre-order number below it (``last``) and its post-order
number. Node a is an ancestor of b in the same tree iff a.pre < b.pre <= a.last, so
tables of single node types stay linked by interval containment alone.

Defined results: a null, empty or broken text, a text that is not an object, and a
tree with any node without a string ``type`` or an integer ``line`` is unusable and
gives no rows; ``children`` that are no array mean none, entries that are no objects are
skipped; ``attributes`` that are no object mean none. Texts sent again under one id
count once: the latest usable one by ``order``, ties by content. Rows with null id are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.cluster import join_small

TREE_SCHEMA = (
    "id long, at timestamp, digest long, parents array<int>, lasts array<int>, posts array<int>, types array<string>, lines array<long>, attributes array<string>"
)

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<w>true|false|null)')


def _refuse(name: str) -> None:
    raise ValueError(name)


_STRICT = json.JSONDecoder(parse_constant=_refuse)
_WORDS = {"true": True, "false": False, "null": None}


def decode(text: str) -> object:
    """JSON of any depth. Raises ValueError when the text isn't valid JSON."""
    try:
        return _STRICT.decode(text)
    except RecursionError:
        return decode_deep(text)


def decode_deep(text: str) -> object:
    """The same without recursion."""
    pos, size = _SPACE.match(text).end(), len(text)
    stack: list[tuple[object, str | None]] = []
    here: object = None
    key: str | None = None
    need = "value"  # value, first (of an array), key, firstkey, after
    root: object = None

    def put(v: object) -> None:
        nonlocal root
        if not stack:
            root = v
        elif isinstance(here, list):
            here.append(v)
        else:
            here[key] = v

    while True:
        pos = _SPACE.match(text, pos).end()
        c = text[pos : pos + 1]
        if need == "after":
            if not stack:
                if pos != size:
                    raise ValueError("text after the value")
                return root
            if c == ",":
                need = "value" if isinstance(here, list) else "key"
            elif c == ("]" if isinstance(here, list) else "}"):
                here, key = stack.pop()
            else:
                raise ValueError(f"unexpected text at {pos}")
            pos += 1
        elif need in ("key", "firstkey"):
            if c == "}" and need == "firstkey":
                here, key = stack.pop()
                pos, need = pos + 1, "after"
                continue
            m = _SCALAR.match(text, pos)
            if not m or m.lastgroup != "s":
                raise ValueError(f"no key at {pos}")
            key = json.loads(m.group())
            pos = _SPACE.match(text, m.end()).end()
            if text[pos : pos + 1] != ":":
                raise ValueError(f"no colon at {pos}")
            pos, need = pos + 1, "value"
        else:
            if c == "]" and need == "first":
                here, key = stack.pop()
                pos, need = pos + 1, "after"
            elif c in "[{" and c:
                v: object = [] if c == "[" else {}
                put(v)
                stack.append((here, key))
                here, pos, need = v, pos + 1, "first" if c == "[" else "firstkey"
            else:
                m = _SCALAR.match(text, pos)
                if not m:
                    raise ValueError(f"no value at {pos}")
                put(_WORDS[m.group()] if m.lastgroup == "w" else json.loads(m.group()))
                pos, need = m.end(), "after"


def as_json(value: object) -> str:
    """JSON text without spaces, objects in their own order."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        stack: list[object] = [(value,)]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x[0], dict) and x[0]:
                stack.append("}")
                for k, (name, v) in reversed(list(enumerate(x[0].items()))):
                    stack += [(v,), ("," if k else "{") + json.dumps(name, ensure_ascii=False) + ":"]
            elif isinstance(x[0], list) and x[0]:
                stack.append("]")
                for k, v in reversed(list(enumerate(x[0]))):
                    stack += [(v,), "," if k else "["]
            else:
                out.append(json.dumps(x[0], ensure_ascii=False))
        return "".join(out)


def label(root: object) -> tuple[list, ...] | None:
    """(parents, lasts, posts, types, lines, attributes) in pre-order; None if unusable.

    A node's attributes are one JSON object of names and the JSON text of each value."""
    if not isinstance(root, dict):
        return None
    parents: list[int] = []
    lasts: list[int] = []
    posts: list[int] = []
    types: list[str] = []
    lines: list[int] = []
    attributes: list[str | None] = []
    post = 0
    stack: list[tuple[object, int]] = [(root, -1)]
    while stack:
        node, parent = stack.pop()
        if node is None:  # all below `parent` is done
            lasts[parent], posts[parent] = len(parents) - 1, post
            post += 1
            continue
        kind, line = node.get("type"), node.get("line")
        if not isinstance(kind, str) or not isinstance(line, int) or isinstance(line, bool) or abs(line) >= 1 << 63:
            return None
        number = len(parents)
        parents.append(parent)
        lasts.append(number)
        posts.append(0)
        types.append(kind)
        lines.append(line)
        own = node.get("attributes")
        attributes.append(json.dumps({k: as_json(v) for k, v in own.items()}) if isinstance(own, dict) and own else None)
        stack.append((None, number))
        below = node.get("children")
        if isinstance(below, list):
            stack += [(x, number) for x in reversed(below) if isinstance(x, dict)]
    return parents, lasts, posts, types, lines, attributes


def _flatten(batches: Iterator[pd.DataFrame], with_values: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for ident, at, digest, text in zip(pdf["id"], pdf["at"], pdf["digest"], pdf["text"]):
            try:
                flat = label(decode(text)) if text else None
            except (ValueError, RecursionError):
                flat = None
            if flat:
                p, la, po, ty, li, att = flat
                out.append((ident, at, digest, p, la, po, *((ty, li, att) if with_values else (None, None, None))))
        yield pd.DataFrame(out, columns=["id", "at", "digest", "parents", "lasts", "posts", "types", "lines", "attributes"])


def flatten_trees(df: DataFrame, ident: str, text: str, order: str, with_values: bool = True) -> DataFrame:
    """One row per usable tree with its labels as arrays; copies of an id count once.

    Only the labels are shuffled for that, never the JSON text."""
    src = df.select(F.col(ident).cast("long").alias("id"), F.col(order).cast("timestamp").alias("at"), F.xxhash64(text).alias("digest"), F.col(text).alias("text")).filter("id is not null and text is not null")
    flat = src.mapInPandas(lambda it: _flatten(it, with_values), TREE_SCHEMA)
    best = flat.groupBy("id").agg(F.max_by(F.struct("parents", "lasts", "posts", "types", "lines", "attributes"), F.struct("at", "digest")).alias("t"))
    return best.select("id", "t.*")


def node_table(trees: DataFrame) -> DataFrame:
    """(id, node_id, parent_id, last, post, type, line): one row per node."""
    z = trees.select("id", F.posexplode(F.arrays_zip("parents", "lasts", "posts", "types", "lines")).alias("node_id", "n"))
    return z.select("id", "node_id", F.col("n.parents").alias("parent_id"), F.col("n.lasts").alias("last"), F.col("n.posts").alias("post"), F.col("n.types").alias("type"), F.col("n.lines").alias("line"))


def parent_links(trees: DataFrame) -> DataFrame:
    """(id, parent_id, node_id) only."""
    return trees.select("id", F.posexplode("parents").alias("node_id", "parent_id")).select("id", "parent_id", "node_id")


def type_table(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("type") == kind)


def write_type_tables(nodes: DataFrame, path: str) -> None:
    """One table per type below ``path``, each in a folder ``type=...``; interval containment links them."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(path)


def attribute_table(trees: DataFrame) -> DataFrame:
    """(id, node_id, name, value): one row per attribute, the value as JSON text (so 1 and "1" differ)."""
    own = trees.select("id", F.posexplode("attributes").alias("node_id", "a")).filter("a is not null")
    return own.select("id", "node_id", F.explode(F.from_json("a", "map<string,string>")).alias("name", "value"))


#: Levels of blocks: node numbers are below 2 ** LEVELS.
LEVELS = 31


def _blocks(first: Column, end: Column) -> Column:
    """The fewest aligned blocks of 2 ** level numbers that make up [first, end): at most two a level."""
    block = "struct<level:int,block:bigint>"

    def step(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        one = lambda at: F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))
        none = F.array().cast(f"array<{block}>")
        left = (lo < hi) & (lo % 2 == 1)
        lo = F.when(left, lo + 1).otherwise(lo)
        right = (lo < hi) & (hi % 2 == 1)
        hi = F.when(right, hi - 1).otherwise(hi)
        got = F.concat(acc["got"], F.when(left, one(acc["lo"])).otherwise(none), F.when(right, one(hi)).otherwise(none))
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), got.alias("got"))

    start = F.struct(first.cast("long").alias("lo"), end.cast("long").alias("hi"), F.array().cast(f"array<{block}>").alias("got"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step)["got"]


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Inner nodes with each outer node that contains them.

    An outer node's interval is cut into aligned blocks, an inner node stands in one block a level: an equi-join finds
    each pair once and no others, however large a tree is. Both sides are read twice: cut them if they are costly."""
    o = outer.select("id", F.col("node_id").alias("outer_id"), F.col("last").alias("outer_last"), F.col("type").alias("outer_type"), F.inline(_blocks(F.col("node_id") + 1, F.col("last") + 1)))
    top = o.agg(F.max("level")).first()[0]
    i = inner.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top or 0)))).withColumn("block", F.call_function("shiftright", F.col("node_id").cast("long"), F.col("level")))
    return join_small(i, o, ["id", "level", "block"]).select(*inner.columns, "outer_id", "outer_last", "outer_type")
