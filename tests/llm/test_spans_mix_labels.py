"""Shared spans, mixing and provenance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import mixing, provenance, shared_spans

FACTS = "file_id long, min_lines int, lines array<int>, hashes array<string>, h string"


def brute_lines(rows):
    one = {}
    for f, k, lines, hashes, _ in rows:
        if f is not None and k and lines is not None and hashes is not None:
            one.setdefault(f, (k, lines, hashes))
    where = {}
    for f, (_, _, hs) in one.items():
        for h in hs:
            if h is not None:
                where.setdefault(h, set()).add(f)
    return {(f, x) for f, (k, lines, hs) in one.items() for i, h in enumerate(hs) if h is not None and len(where[h]) > 1 for x in lines[i : i + k] if x is not None}


def facts(rng, n, hot=0):
    rows = []
    for f in range(n):
        m = rng.randint(0, 12)
        lines = sorted(rng.sample(range(1, 60), m + 2)) if m else []
        hashes = [f"{0 if rng.random() < hot else rng.randint(1, 60):016x}" for _ in range(m)]
        rows.append((f, 3, lines, hashes, "c"))
    return rows


@pytest.mark.parametrize("limit", [20_000, 0])
def test_shared_lines_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", limit)  # 0: hot and cold buckets apart
    monkeypatch.setattr(shared_spans, "HOT_SHARE", 20)
    rng = random.Random(limit)
    rows = facts(rng, 60, 0.3)
    rows += rows[:5] + [(900, None, [1], ["a"], None), (901, 3, None, None, None), (None, 3, [1, 2, 3], [f"{0:016x}"], None), (902, 3, [1, 2, 3], [None], None), (903, 3, [], [], None)]
    df = spark.createDataFrame(rows, FACTS)
    assert {(r.file_id, r.line) for r in shared_spans.line_rows(shared_spans.shared_lines(df)).collect()} == brute_lines(rows)
    got = {r.file_id: (r.code_lines, r.shared_lines) for r in shared_spans.shares(df).collect()}
    want = brute_lines(rows)
    assert all(s == sum(1 for f, _ in want if f == k) for k, (_, s) in got.items())
    assert shared_spans.shared_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [20_000, 0])
def test_components_of_files_equal_union_find(spark, monkeypatch, limit):
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", limit)
    rng = random.Random(5)
    rows = [(f, 2, list(range(30)), [f"{rng.randint(1, 900):016x}" for _ in range(rng.randint(1, 25))], "c") for f in range(70)]
    for f in range(80, 95):  # files with long spans of others
        a, b = rng.sample(rows[:70], 2)
        rows.append((f, 2, list(range(60)), a[3][3:] + b[3][:9], "c"))
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for f, _, _, hs, _ in rows:
        for h in hs:
            where.setdefault(h, set()).add(f)
    for fs in where.values():
        if len(fs) > 1:
            for f in fs:
                parent.setdefault(f, f)
            least = min(map(root, fs))
            for f in fs:
                parent[root(f)] = least
    got = {r.file_id: r.component for r in shared_spans.file_components(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {f: root(f) for f in parent} and len(got) > 60


def test_banding_finds_most_and_the_rest_is_exact(spark):
    rng = random.Random(11)
    pool = [[f"{rng.getrandbits(64):016x}" for _ in range(90)] for _ in range(20)]
    rows = []
    for f in range(120):
        hs = [f"{rng.getrandbits(64):016x}" for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(0, 2)):
            p, size = rng.choice(pool), rng.choice([1, 20, 80])
            a = rng.randrange(90 - size)
            hs[rng.randrange(len(hs)) : 0] = p[a : a + size]
        rows.append((f, 3, list(range(1, len(hs) + 3)), hs, "c"))
    df = spark.createDataFrame(rows, FACTS)
    assert {(r.file_id, r.line) for r in shared_spans.line_rows(shared_spans.shared_lines(df)).collect()} == brute_lines(rows)
    one = shared_spans.band_recall(df).first()
    assert one.recall >= 0.8 and one.by_bands < one.all
    assert shared_spans.band_recall(df.limit(0)).first().recall == 1.0


def test_the_latest_copy_counts(spark):
    h = [f"{k:016x}" for k in range(6)]
    rows = [(1, 2, [1, 2, 3], [h[0], h[1]], 5), (1, 2, [7, 8], [h[5]], 9), (2, 2, [1, 2, 3], [h[0], h[1]], 1), (3, 2, [4, 5], [h[5]], 1)]
    df = spark.createDataFrame(rows, "file_id long, min_lines int, lines array<int>, hashes array<string>, collected_at int")
    assert sorted(map(tuple, shared_spans.line_rows(shared_spans.shared_lines(df)).collect())) == [(1, 7), (1, 8), (3, 4), (3, 5)]


def test_repeats_inside_one_file_do_not_count(spark):
    h = [f"{k:016x}" for k in (1, 1, 2)]
    df = spark.createDataFrame([(1, 2, [1, 2, 3, 4], h, None), (2, 2, [5, 6, 7], [f"{3:016x}", f"{2:016x}"], None)], FACTS)
    assert sorted((r.file_id, r.line) for r in shared_spans.line_rows(shared_spans.shared_lines(df)).collect()) == [(1, 3), (1, 4), (2, 6), (2, 7)]


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in shared_spans.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert shared_spans.components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing


def planned(spark, sizes, targets, total=None):
    held = spark.createDataFrame(list(sizes.items()), "source string, tokens long")
    want = spark.createDataFrame([(k, *v) for k, v in targets.items()], "source string, share double, cap int")
    return {r.source: r["copies"] for r in mixing.plan(held, want, total).collect()}


def test_plan(spark):
    sizes = {"a": 1000, "b": 100, "c": 10}
    p = planned(spark, sizes, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4), "none": (0.0, 1), "gone": (0.1, 3)})
    tokens = {s: p[s] * sizes[s] for s in p}
    assert math.isclose(tokens["a"] / tokens["b"], 5 / 3) and math.isclose(p["c"], 4) and all(v <= {"a": 1, "b": 2, "c": 4}[s] + 1e-9 for s, v in p.items())
    big = planned(spark, sizes, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4)}, 700)
    assert big["c"] == 4 and big["b"] == 2 and math.isclose(big["a"] * 1000, 700 - 200 - 40)
    assert planned(spark, {}, {"a": (1.0, 1)}) == {} and planned(spark, {"a": 5}, {"a": (1.0, 0)}) == {}
    assert planned(spark, sizes, {"a": (0.5, 1), "b": (0.3, 2)}, 10**9) == {"a": 1, "b": 2}


def test_targets_of_one_name_add_up(spark):
    t = spark.createDataFrame([("A-b", 0.2, 3), (" a_B", 0.3, 2), (None, 0.1, 1), ("c", None, None)], "source string, target_share double, max_repeats int")
    assert sorted(map(tuple, mixing.read_targets(t).collect())) == [("a_b", 0.5, 2), ("c", 0.0, 0)]


def test_pivotal_keeps_sums_and_probabilities():
    rng = np.random.default_rng(1)
    p = rng.random(40)
    total = np.zeros(40)
    for k in range(3000):
        out, open_ = mixing.pivotal(p, np.random.default_rng([2, k]))
        assert abs(out.sum() - p.sum()) < 1e-6
        rest = np.delete(out, open_) if open_ >= 0 else out
        assert set(np.unique(rest)) <= {0.0, 1.0}
        total += out
    assert np.abs(total / 3000 - p).max() < 0.05


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_mix_amounts(spark, chunk):
    rng = random.Random(3)
    rows = [(k, "hot" if k % 3 else "b", rng.randint(1, 300)) for k in range(900)] + [(k, "c", 50) for k in range(1000, 1010)] + [(2000, "other", 5), (2001, "hot", 0)]
    sizes = {s: sum(t for _, x, t in rows if x == s) for s in ("hot", "b", "c")}
    docs = {s: sum(1 for _, x, _ in rows if x == s) for s in ("hot", "b", "c")}
    targets = {"hot": (0.5, 1), "b": (0.3, 2), "c": (0.2, 4)}
    copies = planned(spark, sizes, targets)
    table = spark.createDataFrame([(s, copies[s], docs[s]) for s in copies], "source string, copies double, docs long")
    chosen = mixing.mix(sized(spark, rows), table, chunk_docs=chunk).cache()
    got = chosen.collect()
    want = spark.createDataFrame([(s, *v) for s, v in targets.items()], "source string, target_share double, max_repeats int")
    for r in mixing.shares(chosen, want, chunk).collect():
        assert math.isclose(r.wanted_share, targets[r.source][0]) and r.share_error <= r.error_bound and math.isclose(r.share_error, abs(r.actual_share - r.wanted_share))
    assert sorted(r.doc_id for r in got) == sorted(k for k, _, _ in rows)
    tokens = {s: sum(r.tokens * r["copies"] for r in got if r.source == s) for s in sizes}
    for s, (share, cap) in targets.items():
        mine = [r for r in got if r.source == s and r.tokens]
        assert all(math.floor(copies[s] + 1e-9) <= r["copies"] <= min(cap, math.ceil(copies[s] - 1e-9) if copies[s] % 1 else copies[s]) for r in mine)
        assert abs(sum(r["copies"] for r in mine) - copies[s] * len(mine)) <= 1.0  # dependent rounding: the count is kept
        assert abs(tokens[s] / sum(tokens.values()) - share) < (0.02 if chunk > 7 else 0.06)
    assert all(r["copies"] == 0 for r in got if r.source == "other" or not r.tokens)


def test_mix_whole(spark):
    docs = spark.createDataFrame([(1, "A-b ", "hello world", "x"), (2, "a_b", "", "x"), (3, None, "text", "x"), (4, "c", None, "x"), (None, "a_b", "text", "x"), (5, "zzz", "text", "x")], "doc_id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("a_b", 0.5, 2), ("c", 0.3, 1), ("d", 0.2, None)], "source string, target_share double, max_repeats int")
    chosen = mixing.mixed(docs, targets)
    assert {r.doc_id: r["copies"] for r in chosen.collect()} == {1: 2, 2: 0, 4: 0}
    s = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    assert s["a_b"].actual_share == 1.0 and s["d"].docs == 0 and s["c"].actual_share == 0.0
    assert mixing.mixed(docs.limit(0), targets).count() == 0
    assert mixing.mixed(docs, targets.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer_itself():
    pytest.importorskip("public_tokenizers")
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc = mixing.encoder(f"{mixing.TOKENIZER_DIR}/{mixing.VOCABULARY}")
    for text in ["Hello, world!  12 <|endoftext|>", "Це правило 語\n\n  x", ""]:
        assert len(enc.encode_ordinary(text)) == len(t.encode(text, add_special_tokens=False).ids)


# provenance


HAND = "import os\n\n\ndef load(path, mode):\n    if mode == 1:\n        return open(path)\n    for name in os.listdir(path):\n        print(name)\n    with open(path) as f:\n        text = f.read()\n    return text.strip()\n"
GENERATED = "# Code generated by toolgen from x.proto. DO NOT EDIT.\n" + "".join(f"def field_{k}(n):\n    return n + {k}\n" for k in range(20))
UNMARKED = "".join(f"VALUE_{k} = {k * 7}\n" for k in range(40))
MINIFIED = "var a=1,b=2;" + "".join(f"function f{k}(x,y){{return x*{k}+y}}" for k in range(40))
VENDORED = "/*!\n * libfoo v1.2.3\n * MIT, Foo team\n */\n" + "function load(path, mode) {\n  if (mode) {\n    return open(path)\n  }\n  const name = list(path)\n  return name.trim()\n}\n"
BLOB = "data = [\n" + "".join(f"  {k * 17}, {k * 31}, {k * 7},\n" for k in range(60)) + "]\n"


def test_evidence_of_single_files():
    for text, lang, file, label in ((HAND, "python", "a.py", 0), (GENERATED, "python", "a.py", 1), (UNMARKED, "python", "a.py", 1), (MINIFIED, "js", "a.js", 2), (VENDORED, "js", "src/libfoo/a.js", 3), (BLOB, "python", "a.py", 4), (None, "js", "a.js", 0), ("", "js", "x/generated/a.js", 0)):
        e = provenance.evidence(text, lang, file)
        assert max(range(5), key=lambda k: e[k]) == label, (label, e)


TABLES = ([[1.0 + (3 * a + 2 * b) % 5 + 4 * (a == b) for b in range(5)] for a in range(5)], [[2.0 + (a + 3 * b) % 4 + 5 * (a == b) for b in range(5)] for a in range(5)])


def brute_beliefs(files):
    """Sum-product by enumeration of all directory labels: psi over (dir, parent) and (file, dir)."""
    import itertools

    dirs = sorted({""} | {"/".join(d.split("/")[: k + 1]) for _, d, _ in files if d for k in range(d.count("/") + 1)})
    out = {f: np.zeros(5) for f, _, _ in files}
    for labels in itertools.product(range(5), repeat=len(dirs)):
        at = dict(zip(dirs, labels))
        w = 1.0
        for d in dirs:
            if d:
                w *= TABLES[1][at[d.rpartition("/")[0]]][at[d]]
        local = {f: np.exp(e) * np.array(TABLES[0][at[d]]) for f, d, e in files}
        total = w * np.prod([v.sum() for v in local.values()])
        for f, v in local.items():
            out[f] += total * v / v.sum()
    return {f: v / v.sum() for f, v in out.items()}


def test_propagation_equals_enumeration(spark):
    rng = np.random.default_rng(6)
    where = ["", "a", "a/b", "a/b", "c/d", "c/d", "a"]
    files = [(k, d, rng.normal(0, 1.5, 5)) for k, d in enumerate(where)]
    df = spark.createDataFrame([(k, "r", d, True, *map(float, e)) for k, d, e in files], "file_id long, repo string, dir string, valid boolean, " + ", ".join(f"{c} double" for c in provenance.E))
    got = {r.file_id: (r.label, r.confidence) for r in provenance.propagate(df, TABLES).collect()}
    for k, p in brute_beliefs(files).items():
        assert got[k][0] == provenance.LABELS[int(p.argmax())] and abs(got[k][1] - p.max()) < 1e-6
    assert provenance.propagate(df.limit(0)).count() == 0


def test_file_labels(spark):
    rows = [(1, "r", "src/a.py", HAND), (1, "r", "src/a.py", HAND), (2, "r", "gen\\b.py", GENERATED), (3, None, "c.js", MINIFIED), (4, "r", "lib/libfoo/d.js", VENDORED), (5, "r", "e.py", BLOB), (6, "r", "f.py", GENERATED + "def ("), (7, "r", "g.yml", "a: 1"), (8, "r", "h.py", None), (None, "r", "i.py", HAND), (9, "r", None, HAND)]
    labels = provenance.file_labels(spark.createDataFrame([(*x, "c") for x in rows], "file_id long, repo string, file string, source string, label string"))
    assert {r.file_id: r.label for r in labels.collect()} == {1: "handwritten", 2: "generated", 3: "minified", 4: "vendored", 5: "blob", 6: "generated", 8: "handwritten"}
    assert sorted(r.file_id for r in provenance.not_handwritten(labels).collect()) == [2, 3, 4, 5]


def test_siblings_pull_an_unsure_file(spark):
    cols = "file_id long, repo string, dir string, valid boolean, " + ", ".join(f"{c} double" for c in provenance.E)
    tables = provenance.EVEN, provenance.EVEN
    sure, unsure = [-5.0, 0.0, -5.0, -5.0, -5.0], [0.3, 0.0, -5.0, -5.0, -5.0]
    alone = spark.createDataFrame([(1, "r", "d", True, *unsure)], cols)
    many = spark.createDataFrame([(1, "r", "d", True, *unsure)] + [(k, "r", "d", True, *sure) for k in range(2, 8)], cols)
    assert provenance.propagate(alone, tables).first().label == "handwritten"
    assert provenance.propagate(many, tables).filter(F.col("file_id") == 1).first().label == "generated"


def test_compatibilities_are_counted(spark):
    n = lambda *x: [float(v) for v in x]
    rows = [("r", "", "", n(4, 0, 0, 0, 0)), ("r", "a", "", n(6, 0, 0, 0, 0)), ("r", "a/v", "a", n(0, 0, 0, 5, 0)), ("r", "a/v/w", "a/v", n(0, 0, 0, 2, 0)), ("s", "g", "", n(1, 1, 0, 0, 0)), ("s", "h", "", n(0, 1, 0, 0, 0))]
    of_file, of_dir = provenance.compatibilities(spark.createDataFrame(rows, "repo string, dir string, parent string, n array<double>"))
    assert of_file[3][3] > 1 > of_file[3][0] and of_file[0][0] > 1 and all(1 / provenance.MOST_RATIO <= x <= provenance.MOST_RATIO for t in (of_file, of_dir) for r in t for x in r)
    assert of_dir[3][3] > of_dir[0][3] and provenance.ratios([[0.0] * 5] * 5) == [[1.0] * 5] * 5


def test_directory_names_reach_files_below(spark):
    cols = "file_id long, repo string, dir string, valid boolean, " + ", ".join(f"{c} double" for c in provenance.E)
    unsure = [0.4, -9.0, -9.0, 0.0, -9.0]
    df = spark.createDataFrame([(1, "r", "third_party/x", True, *unsure), (2, "r", "src/x", True, *unsure)], cols)
    got = {r.file_id: (r.alone, r.label) for r in provenance.propagate(df, (provenance.EVEN, provenance.EVEN)).collect()}
    assert got == {1: ("handwritten", "vendored"), 2: ("handwritten", "handwritten")}
    assert sorted(map(tuple, provenance.changes(provenance.propagate(df, (provenance.EVEN, provenance.EVEN))).collect())) == [("handwritten", "handwritten", 1, 0), ("handwritten", "vendored", 1, 1)]
