import json
import random
from datetime import datetime

import pytest

from treeline import cluster
from treeline.operators import nested, tree


def node(kind="Other", line=1, *children, **attributes):
    return {"type": kind, "line": line, "attributes": attributes, "children": list(children)}


def random_tree(rng, depth=0):
    kids = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 4 else 0))]
    out = {"type": rng.choice(["If", "Block", "FunctionDecl"]), "line": rng.randint(1, 9)}
    if kids or rng.random() < 0.5:
        out["children"] = kids + ([1, "x", None] if rng.random() < 0.2 else [])
    return out


def recursive(n, parent, out):
    me = len(out)
    out.append(parent)
    for c in n.get("children") or []:
        if isinstance(c, dict):
            recursive(c, me, out)
    return out


def test_labels_equal_recursion_and_nest():
    rng = random.Random(1)
    for _ in range(200):
        t = random_tree(rng)
        parents, lasts, posts, *_ = nested.label(t)
        assert parents == recursive(t, -1, [])
        n = len(parents)
        assert sorted(posts) == list(range(n))
        for a in range(n):
            for b in range(n):
                up, is_anc = b, False
                while up >= 0:
                    up = parents[up]
                    is_anc |= up == a
                assert is_anc == (a < b <= lasts[a]) == (a < b and posts[b] < posts[a])


@pytest.mark.parametrize("text", ["[1, {\"a\": [true, null, -1.5e3, \"\\u00e9\\n\"]}, {}, []]", " 1 ", "\"x\"", "{\"a\":1,\"a\":2}"])
def test_deep_decoder_equals_json(text):
    assert nested.decode_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", "{\"a\"}", "{1:2}", "nul", "[1] 2", "{\"a\":1,}", "\"\t\"", "01"])
def test_deep_decoder_refuses(text):
    with pytest.raises(ValueError):
        nested.decode_deep(text)


def test_any_depth():
    text = '{"type":"Block","line":1,"children":[' * 60_000 + "]}" * 60_000
    flat = nested.label(nested.decode(text))
    assert len(flat[0]) == 60_000 and flat[1][0] == 59_999


CASES = [
    ('{"type":"Root","line":1}', [-1]),
    ('{"type":"Root","line":1,"children":null,"attributes":[1]}', [-1]),
    ('{"type":"Root","line":1,"children":{"type":"x","line":1}}', [-1]),
    ('{"type":"Root","line":1,"children":[1,{"type":"If","line":2},"x"]}', [-1, 0]),
    ('{"type":"Root","line":1.0}', None),
    ('{"type":"Root","line":true}', None),
    ('{"type":7,"line":1}', None),
    ('{"type":"Root","line":1,"children":[{"type":"If"}]}', None),
    ("[]", None), ("", None), ("{", None), (None, None), ("NaN", None),
]


def test_usable_and_unusable(spark):
    rows = [(k, t, datetime(2026, 1, 1), "clash") for k, (t, _) in enumerate(CASES)] + [(None, CASES[0][0], datetime(2026, 1, 1), "x")]
    df = spark.createDataFrame(rows, "dump_id long, ast_json string, dumped_at timestamp, parents string")
    got = {}
    for r in nested.parent_links(nested.flatten_trees(df, "dump_id", "ast_json", "dumped_at", False)).collect():
        got.setdefault(r.id, {})[r.node_id] = r.parent_id
    assert got == {k: dict(enumerate(p)) for k, (_, p) in enumerate(CASES) if p}


def test_copies_count_once_and_latest_usable_wins(spark):
    one, two = json.dumps(node("A", 1, node("B", 2))), json.dumps(node("C"))
    rows = [(1, one, datetime(2026, 1, 1)), (1, json.dumps(json.loads(one), indent=2), datetime(2026, 1, 1)), (1, two, datetime(2026, 1, 2)), (1, "broken", datetime(2026, 1, 3))]
    df = spark.createDataFrame(rows, "i long, t string, at timestamp")
    n = nested.node_table(nested.flatten_trees(df, "i", "t", "at")).collect()
    assert [(r.type, r.parent_id) for r in n] == [("C", -1)]


def test_attributes_and_containment(spark):
    t = node("Root", 1, node("FunctionDecl", 2, node("If", 3, node("If", 4)), name="f", span={"a": 1}), node("If", 9))
    df = spark.createDataFrame([(1, json.dumps(t), datetime(2026, 1, 1))], "i long, t string, at timestamp")
    trees = nested.flatten_trees(df, "i", "t", "at")
    assert {(r.node_id, r.name, r.value) for r in nested.attribute_table(trees).collect()} == {(1, "name", '"f"'), (1, "span", '{"a":1}')}
    n = nested.node_table(trees)
    pairs = nested.within(nested.type_table(n, "If"), nested.type_table(n, "FunctionDecl")).collect()
    assert sorted((r.outer_id, r.node_id) for r in pairs) == [(1, 2), (1, 3)]


def test_attribute_values_keep_their_kind(spark):
    attributes = {"a": 1, "b": "1", "c": None, "d": [1, {"z": None, "a": "ж"}], "e": 1.5, "f": True, "g": "\ud800"}
    deep = '{"type":"A","line":1,"attributes":{"x":' + '[{"k":' * 5000 + "1" + "}]" * 5000 + "}}"
    df = spark.createDataFrame([(1, json.dumps({"type": "A", "line": 1, "attributes": attributes}), None), (2, deep, None)], "i long, t string, at timestamp")
    got = {(r.id, r.name): r.value for r in nested.attribute_table(nested.flatten_trees(df, "i", "t", "at")).collect()}
    assert {k: got[1, k] for k in "abcdef"} == {"a": "1", "b": '"1"', "c": "null", "d": '[1,{"z":null,"a":"ж"}]', "e": "1.5", "f": "true"}
    assert got[2, "x"] == deep[deep.index("[") : -2]


@pytest.mark.parametrize("limit", [20_000, 0])
def test_within_equals_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(nested, "join_small", lambda a, b, keys: cluster.join_small(a, b, keys, limit=limit))
    rng = random.Random(2)

    def make(depth):
        return {"type": rng.choice("AB"), "line": 1, "children": [make(depth + 1) for _ in range(rng.randint(0, 4 if depth < 6 else 0))]}

    df = spark.createDataFrame([(k, json.dumps(make(0)), None) for k in range(12)], "i long, t string, at timestamp")
    n = nested.node_table(nested.flatten_trees(df, "i", "t", "at")).cache()
    rows = n.collect()
    want = sorted((a.id, a.node_id, b.node_id) for a in rows for b in rows if a.id == b.id and a.type == "A" and b.type == "B" and a.node_id < b.node_id <= a.last)
    got = nested.within(nested.type_table(n, "B"), nested.type_table(n, "A"))
    assert sorted((r.id, r.outer_id, r.node_id) for r in got.collect()) == want and len(want) > 100
    assert nested.within(n.limit(0), n).count() == 0 and nested.within(n, n.limit(0)).count() == 0


def test_tables_per_type(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps(node("Root", 1, node("If", 2), node("If", 3))), None)], "i long, t string, at timestamp")
    nested.write_type_tables(nested.node_table(nested.flatten_trees(df, "i", "t", "at")), f"{tmp_path}/nodes")
    assert spark.read.parquet(f"{tmp_path}/nodes/type=If").count() == 2 and spark.read.parquet(f"{tmp_path}/nodes/type=Root").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "i long, t string, at timestamp")
    assert nested.parent_links(nested.flatten_trees(df, "i", "t", "at")).count() == 0


def direct(root):
    """Metrics by plain recursion."""
    out = []

    def walk(n, parent, nest, acc):
        for c in n.get("children", []):
            if c["type"] == "FunctionDecl":
                continue
            if c["type"] in tree.BRANCH:
                cont = c["type"] == "If" and n["type"] == "If"
                acc[0] += 1
                acc[1] += 1 if cont else 1 + nest
                walk(c, n, nest if cont else nest + 1, acc)
            else:
                walk(c, n, nest, acc)

    def every(n):
        if n["type"] == "FunctionDecl":
            acc = [1, 0]
            walk(n, None, 0, acc)
            body = next((c for c in n.get("children", []) if c["type"] == "Block"), {})
            out.append((*acc, len(body.get("children", []))))
        for c in n.get("children", []):
            every(c)

    every(root)
    return out


def test_metrics_equal_recursion_on_random_trees(spark):
    rng = random.Random(3)
    kinds = [*tree.BRANCH, "Block", "FunctionDecl", "TryCatch", "Other", "If"]

    def make(depth):
        return {"type": rng.choice(kinds), "line": rng.randint(1, 50), "children": [make(depth + 1) for _ in range(rng.randint(0, 3 if depth < 6 else 0))]}

    roots = [make(0) for _ in range(150)]
    df = spark.createDataFrame([(k, json.dumps(r), datetime(2026, 1, 1)) for k, r in enumerate(roots)], "i long, t string, at timestamp")
    got = {}
    for r in tree.function_metrics(tree.nodes_of_trees(nested.flatten_trees(df, "i", "t", "at"))).orderBy("node_id").collect():
        got.setdefault(int(r.id), []).append((r.cyclomatic, r.cognitive, r.statements))
    assert got == {k: d for k, r in enumerate(roots) if (d := direct(r))}
