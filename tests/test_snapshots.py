import random
from datetime import datetime, timedelta

from treeline.operators.snapshots import snapshot_changes

SCHEMA = "entry_id long, repo string, snapshot_no int, delivered_at timestamp, file string, rule string, message string, count int, change string"
T0 = datetime(2026, 1, 1)


def brute(rows):
    last = {}
    for e, repo, no, at, *_ in rows:
        if repo is not None and no is not None and at is not None:
            last[repo, no] = max(last.get((repo, no), at), at)
    state = {k: {} for k in last}
    for e, repo, no, at, file, rule, msg, n, _ in rows:
        if (repo, no) in last and at == last[repo, no]:
            f = (file or "").replace("\\", "/")
            while f.startswith("./"):
                f = f[2:].lstrip("/")
            d = state[repo, no].setdefault((f, rule or "", msg or ""), {})
            d[e] = max(d.get(e, -(1 << 60)), 1 if n is None else n)
    out = set()
    for repo in {r for r, _ in last}:
        nos = sorted(n for r, n in last if r == repo)
        for a, b in zip(nos, nos[1:]):
            old = {k: sum(v.values()) for k, v in state[repo, a].items()}
            new = {k: sum(v.values()) for k, v in state[repo, b].items()}
            for k in old.keys() | new.keys():
                if old.get(k) != new.get(k):
                    out.add((repo, b, *k, "added" if k not in old else "removed" if k not in new else "changed"))
    return out


def ours(spark, rows, **kw):
    df = snapshot_changes(spark.createDataFrame(rows, SCHEMA), **kw)
    got = [(r.repo, r.snapshot_no, r.file, r.rule, r.message, r.change) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_snapshots_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        repo = rng.choice(["hot", "hot", "a", "b"])
        no = rng.choice([1, 2, 4, 7, 9])
        at = T0 + timedelta(days=no, hours=rng.choice([0, 0, 0, 5]) if repo == "a" else 0)
        file = rng.choice(["src/a.py", "./src/a.py", "src\\a.py", "b.py", None, ""])
        rows.append((k, repo, no, at, file, rng.choice(["r1", "r2", None]), rng.choice(["m", "n", "", None]), rng.choice([None, 1, 2, 3]), "clash"))
    rows += rows[:100]  # sent again
    rows += [(9001, None, 1, T0, "x", "r", "m", 1, None), (9002, "a", None, T0, "x", "r", "m", 1, None), (9003, "a", 1, None, "x", "r", "m", 1, None)]
    want = brute(rows)
    assert ours(spark, rows) == want
    assert ours(spark, rows, bucket_rows=7) == want  # many buckets give the same


def test_first_snapshot_and_empty_table(spark):
    assert ours(spark, [(1, "a", 3, T0, "f", "r", "m", 1, None)]) == set()
    assert ours(spark, []) == set()


def test_gap_uses_the_previous_delivered_snapshot(spark):
    rows = [(1, "a", 1, T0, "f", "r", "m", 1, None), (2, "a", 5, T0, "g", "r", "m", 1, None)]
    assert ours(spark, rows) == {("a", 5, "f", "r", "m", "removed"), ("a", 5, "g", "r", "m", "added")}


def test_pieces_of_one_key_add_up(spark):
    rows = [(1, "a", 1, T0, "f", "r", "m", 3, None), (2, "a", 2, T0, "f", "r", "m", 1, None), (3, "a", 2, T0, "./f", "r", "m", 2, None)]
    assert ours(spark, rows) == set()


def test_very_long_values(spark):
    rows = [(1, "a", 1, T0, "f" * 100_000, "r", "m", 1, None), (2, "a", 2, T0, "f" * 100_000, "r", "m", 2, None)]
    assert [x[-1] for x in ours(spark, rows)] == ["changed"]
