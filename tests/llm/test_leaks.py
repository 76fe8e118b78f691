import random

from treeline.llm import leaks

WORDS = "when the tracer meets a marker inside code it must keep records until stage of ends assume that walks every branch twice and returns only where equals limit".split()


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = leaks.words(t or "") if d is not None else []
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, u in items:
            v = leaks.words(u or "") if i is not None else []
            if any(tuple(v[k : k + 12]) in have for k in range(len(v) - 11)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, shape string"), spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, plain string")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("bdgklmnrstz") + rng.choice("aeiou") for _ in range(4))
    items = [(k, " ".join(rng.choice(WORDS) if rng.random() < 0.7 else name() for _ in range(rng.randint(5, 60)))) for k in range(30)]
    items.append((902, max(items, key=lambda x: len(x[1]))[1]))  # two items with one text
    docs = [(800, items[-1][1])]
    for d in range(200):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 20)))]
        if rng.random() < 0.6:
            w = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(w))
            parts.append(" ".join(w[a : a + rng.choice([8, 11, 12, 13, 30])]))
        parts.append(name())
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (None, items[0][1]), docs[0]]
    items += [(900, None), (901, ""), (None, docs[3][1])]
    got = [(r.doc_id, r.item_id) for r in leaks.leaks(*frames(spark, docs, items)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)
    assert any(i == 902 for _, i in got)


def test_marks_between_words_do_not_matter(spark):
    passage = "Assume that kelo walks every fana branch twice and returns muki only where"
    forms = [
        passage.upper(), passage.replace(" ", "\n> "), passage.replace(" ", " \u200b"), passage.replace("every", "ev\u00adery"), passage.replace(" ", " **"), passage.replace("fana branch", "fana\n// branch"), passage.replace("fana branch", "fana\n12. branch"),
        passage.replace(" ", "\u00a0"), "`" + passage.replace(" ", "` `") + "`", passage.replace("kelo walks", "kelo\n * walks"), '"' + passage.replace("twice", 'twice"\n"') + '"',
    ]
    docs = [(k, f) for k, f in enumerate(forms)] + [(99, passage.replace("twice", "often"))]
    assert sorted(r.doc_id for r in leaks.leaks(*frames(spark, docs, [(1, passage)])).collect()) == list(range(len(forms)))


def test_reworded_questions(spark):
    items = [(k, f"the {n} table maps {a} to {b} and leaves {c} blank although {a} asked for more rows") for k, (n, a, b, c) in enumerate([("zuna", "kelo", "fimu", "bera"), ("hopi", "dola", "giru", "suta"), ("lapo", "mive", "noka", "rubi")])]
    docs = [(1, "the 1234 table maps tovi to wexa and leaves pilu blank although tovi asked for more rows"), (2, "the 1234 table maps tovi to wexa and leaves pilu blank although wexa asked for more rows"), (3, items[0][1]), (4, "nothing of the kind")]
    d, i = frames(spark, docs, items)
    got = {r.doc_id for r in leaks.reworded_leaks(d, i).collect()}
    assert 3 not in got and 4 not in got
    assert {r.doc_id for r in leaks.leaks(d, i).collect()} == {3}
    assert leaks.item_report(leaks.leaks(d, i)).first().documents == 1


def test_empty_and_long(spark):
    d, i = frames(spark, [(1, "a " * 200_000 + "one two three four five six seven eight nine ten eleven twelve")], [(7, "zero one two three four five six seven eight nine ten eleven twelve more")])
    assert [(r.doc_id, r.item_id) for r in leaks.leaks(d, i).collect()] == [(1, 7)]
    assert leaks.leaks(d.limit(0), i).count() == 0 and leaks.leaks(d, i.limit(0)).count() == 0


def test_reworded_items_of_their_own_wording(spark):
    own = "careful gardeners prune 12 old apple trees before early spring because strong late frost harms"
    items = [(1, own), (2, "quiet rivers carry fine sand along broad valleys until slow water drops every grain there")]
    docs = [(1, own.replace("12", "57").replace("apple", "cherry").replace("frost", "storm")), (2, own), (3, "quick foxes cross 31 new stone roads after dark night while loud young hound barks")]
    assert {(r.doc_id, r.item_id) for r in leaks.reworded_leaks(*frames(spark, docs, items)).collect()} == {(1, 1)}
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(400))) for k in range(50)]  # windows of slots alone join nothing
    assert leaks.reworded_leaks(*frames(spark, docs, items)).count() == 0
