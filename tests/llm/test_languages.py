"""Hidden text and document languages: held-out sentences, edge cases."""

import random
import pytest
from pyspark.sql import functions as F

from treeline.llm import doc_language, hidden_text, labels
from treeline.llm.kinds import content_kind

# Sentences that are in no seed.
HELD_OUT = {
    "en": ["The garden behind the house was full of red apples this year.", "They could not find the key, although everyone had looked for it twice.", "When will the next train to the city leave from this platform?"],
    "uk": ["У саду за будинком цього року було багато червоних яблук.", "Вони не змогли знайти ключ, хоча всі шукали його двічі.", "Коли відправляється наступний потяг до міста з цієї платформи?"],
    "ru": ["В саду за домом в этом году было много красных яблок.", "Они не смогли найти ключ, хотя все искали его дважды.", "Когда отправляется следующий поезд в город с этой платформы?"],
    "de": ["Der Garten hinter dem Haus war dieses Jahr voller roter Äpfel.", "Sie konnten den Schlüssel nicht finden, obwohl alle zweimal danach gesucht hatten.", "Wann fährt der nächste Zug in die Stadt von diesem Gleis ab?"],
    "fr": ["Le jardin derrière la maison était plein de pommes rouges cette année.", "Ils n'ont pas pu trouver la clé, bien que tout le monde l'ait cherchée deux fois.", "Quand part le prochain train pour la ville de ce quai ?"],
    "es": ["El jardín detrás de la casa estaba lleno de manzanas rojas este año.", "No pudieron encontrar la llave, aunque todos la habían buscado dos veces.", "¿Cuándo sale el próximo tren hacia la ciudad desde este andén?"],
    "pt": ["O jardim atrás da casa estava cheio de maçãs vermelhas este ano.", "Eles não conseguiram encontrar a chave, embora todos a tivessem procurado duas vezes.", "Quando parte o próximo comboio para a cidade desta plataforma?"],
    "pl": ["Ogród za domem był w tym roku pełen czerwonych jabłek.", "Nie mogli znaleźć klucza, chociaż wszyscy szukali go dwa razy.", "Kiedy odjeżdża następny pociąg do miasta z tego peronu?"],
    "zh": ["今年房子后面的花园里长满了红苹果。", "虽然大家找了两遍，但他们还是没有找到钥匙。", "下一班开往城里的火车什么时候从这个站台出发？"],
    "ja": ["今年は家の裏の庭に赤いりんごがたくさん実りました。", "みんなで二回も探したのに、鍵は見つかりませんでした。", "次の町行きの電車はいつこのホームから出ますか。"],
}
CASES = [(la, s) for la, ss in HELD_OUT.items() for s in ss]


def test_encoders_on_held_out_sentences():
    enc = hidden_text.fit([])
    hits = [enc.language(hidden_text.bare_text(s)) == la for la, s in CASES]
    assert sum(hits) >= 0.85 * len(hits)


def test_filters_on_held_out_sentences():
    f = doc_language.fit([])
    best, _, conf = f.decide([doc_language.bare(s) for _, s in CASES])
    hits = [doc_language.LANGS[b] == la for b, (la, _) in zip(best, CASES)]
    assert sum(hits) >= 0.9 * len(hits)
    assert ((conf >= 0) & (conf <= 1)).all()


def accuracy(enc, f):
    best, _, _ = f.decide([doc_language.bare(s) for _, s in CASES])
    return sum(enc.language(hidden_text.bare_text(s)) == la for la, s in CASES) / len(CASES), sum(doc_language.LANGS[b] == la for b, (la, _) in zip(best, CASES)) / len(CASES)


def test_wrong_labels_do_not_spoil_the_fit():
    right = [(la, s) for la, s in CASES] * 3
    wrong = [("de", s) for s in HELD_OUT["fr"] * 2] + [("en", s) for s in HELD_OUT["uk"] * 2] + [("pl", s) for s in HELD_OUT["ja"] * 2]
    clean = accuracy(hidden_text.fit(right), doc_language.fit(right))
    noisy = accuracy(hidden_text.fit(right + wrong), doc_language.fit(right + wrong))
    assert min(clean) >= 0.85 and all(n >= c - 0.05 for n, c in zip(noisy, clean))


def test_bit_sliced_filter_holds_what_was_put_in():
    f = doc_language.fit([])
    for k, code in enumerate(labels.LANGS):
        h, _ = doc_language.grams([doc_language.bare(labels.SEEDS[code])])
        own = ((f.masks(h) >> k) & 1).mean()
        assert own > 0.8, code
    assert (f.false_rate < 0.01).all()


NOT_TEXT = [
    "int totalCount = sum(left, right);", "SELECT id, name FROM users", "git commit -m fix", "a.module.setting.enabled", "src/main/java/app/file.tmp", "MIT, Dosula team", "kelora v1.2.3", "https://a.example/b c d", "x y", "foldSpan = n * 12", "-----BEGIN RSA PRIVATE KEY-----",
    "collect_record_offset = k * k", "fooBar bazQux quuxCorge graultGarply",
]


@pytest.mark.parametrize("line", NOT_TEXT)
def test_code_like_lines_are_not_text(line):
    assert list(hidden_text.text_lines(hidden_text.fit([]), [(1, line)])) == []


FILES = {
    "a.c": ('#include "the nice file of yours.h"\nint x; // This comment tells what the value is for\n/* Diese Zeile erklärt den Wert genauer\n * och und das ist noch eine Zeile davon\n */\nputs("Nothing was found in this file");\nputs("app.start");\n', {(2, "en"), (3, "de"), (4, "de"), (6, "en")}),
    "a.py": ('"""Returns the number of lines that were read.\n\nЦя функція повертає кількість рядків.\n"""\nx = "a b c"  # foldSpan = n * 12\n', {(1, "en"), (3, "uk")}),
    "a.lua": ("--[[ Cette ligne explique la valeur\n et celle-ci explique les autres valeurs de la liste ]]\nlocal s = [[ nothing ]] -- Ta linia mówi o wartości pola\n", {(1, "fr"), (2, "fr"), (3, "pl")}),
    "a.js": ("const r = /this is not a comment \" at all/g\nconst t = `Esta línea explica el valor de la lista`\n", {(2, "es")}),
    "a.yml": ("# Nobody has tested this value yet\nkey: 'plain'\nother: \"It does not work when empty\"\n", {(1, "en"), (3, "en")}),
    "b.c": ("# Title\n\nThis is a text about the parser and nothing else.\n", set()),
    "c.go": ("<!DOCTYPE html>\n<html><body>// not a comment of any language here</body></html>\n", set()),
    "d.txt": ("// This comment is in a file of unknown kind\n", set()),
}


def test_places_in_files(spark):
    rows = [(k, name, text, "clash") for k, (name, (text, _)) in enumerate(FILES.items())] * 2 + [(90, "a.c", None, None), (91, "a.c", "", None), (None, "a.c", "// A comment without any id here", None), (92, None, "// x", None)]
    df = spark.createDataFrame(rows, "file_id long, file string, source string, lang string")
    got = {}
    for r in hidden_text.source_text(df, hidden_text.fit([])).collect():
        got.setdefault(r.record_id, set()).add((r.line, r.lang))
    assert got == {k: want for k, (_, want) in enumerate(FILES.values()) if want}
    shares = hidden_text.language_shares(hidden_text.source_text(df, hidden_text.fit([]))).groupBy("record_id").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)


def test_messages(spark):
    rows = [(1, "Diese Funktion sollte man in kleinere Schritte zerlegen"), (2, "Block under `fooBar` has no statements at all"), (3, "x"), (4, None), (4, ""), (None, "This one has no id at all"), (1, "Diese Funktion sollte man in kleinere Schritte zerlegen")]
    df = spark.createDataFrame(rows, "finding_id long, message string")
    assert sorted((r.record_id, r.line, r.lang) for r in hidden_text.message_text(df, hidden_text.fit([])).collect()) == [(1, 1, "de"), (2, 1, "en")]


def test_very_long_and_empty(spark):
    long = "// The value is read again when it is needed\n" * 20_000
    df = spark.createDataFrame([(1, "a.c", long)], "file_id long, file string, source string")
    assert hidden_text.source_text(df, hidden_text.fit([])).count() == 20_000
    assert hidden_text.source_text(df.limit(0), hidden_text.fit([])).count() == 0


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN_gb", "en"), (" English ", "en"), ("zh-Hans", "zh"), ("ukr", "uk"), ("pt-BR", "pt"), ("Deutsch", "de"), ("", None), (None, None), ("und", None), ("n/a", None), ("unknown", None), ("xx", None)])
def test_label_notations(label, code):
    assert labels.label_code(label) == code


def test_kinds():
    assert content_kind("int f() { return 1", "c") and content_kind("<?php x y", "php")
    assert not content_kind("diff a/x b/y\n@@ -1,2 +3,4 @@\n-int x;\n", "c")
    assert not content_kind("local function f(a)\n  return a\nend\n", "python")
    assert not content_kind('{\n  "a": 1\n}', "go")
    assert content_kind("<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", "c")


# documents


def prose(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, label string")
    return doc_language.prose_languages(df, doc_language.fit([]))


TEXT = "# Title\n\nThis is the first line of the text.\nКоли файл порожній, перевірка нічого не показує.\n```\nthis is code and not a line of text\n```\nfoo.php:12 E5 bar\nx = walk(y, 3)\n- Y esta es otra línea del mismo texto\n今天服务器又没有响应任何请求。\nok\n"


def test_document_lines(spark):
    got = {(r.doc_id, r.line, r.lang) for r in doc_language.wrong_lines(prose(spark, [(1, "en-US", TEXT, "x"), (2, None, "This is the only line here.", "x"), (3, "eng", "This is the only line here.", "x"), (4, "en", None, "x"), (5, "en", "", "x"), (None, "en", TEXT, "x"), (6, "de", "kurz", "x")])).collect()}
    assert got == {(1, 4, "uk"), (1, 10, "es"), (1, 11, "zh"), (2, 1, "en")}


def test_segments_and_documents(spark):
    p = prose(spark, [(1, "en", TEXT, None), (2, "fr", "This is the first line of the text.\nAnd this is the second one of them.", None)])
    assert [(r.first_line, r.last_line, r.lang) for r in doc_language.segments(p).filter("doc_id = 1").orderBy("first_line").collect()] == [(3, 3, "en"), (4, 4, "uk"), (10, 10, "es"), (11, 11, "zh")]
    d = {r.doc_id: r for r in doc_language.document_languages(p).collect()}
    assert d[2].lang == "en" and not d[2].label_right and d[2].share == 1.0
    assert prose(spark, []).count() == 0


def test_invisible_marks_and_long_document(spark):
    text = "Th\u00adis is the\u200b first line of the text.\n" * 5000
    assert prose(spark, [(1, "en", text, None)]).filter("lang = 'en'").count() == 5000


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("some text of a document number "), F.col("id")).alias("text"))
    a, b = labels.labelled_sample(df, rows=100), labels.labelled_sample(df.repartition(7), rows=100)
    assert a == b and 60 <= len(a) <= 100
    assert labels.labelled_sample(df.limit(0)) == []


def test_blocks_do_not_change_scores(monkeypatch):
    f = doc_language.fit([])
    texts = [doc_language.bare(s) for _, s in CASES] + ["", "x", doc_language.bare(" ".join(HELD_OUT["de"] * 50))]
    whole = f.scores(texts)
    small = doc_language.blocks
    monkeypatch.setattr(doc_language, "blocks", lambda t: small(t, 200))
    assert abs(f.scores(texts) - whole).max() < 1e-12
    assert [p for _, ps, _ in small(["abcdef", "gh"], 4) for p in ps] == [" abc", "abcdef ", " gh "]
    assert f.scores([]).shape == (0, len(doc_language.LANGS))


def test_every_document_has_a_language(spark):
    filters = doc_language.fit([])
    rows = [(1, "en", "Looks good\nthank you\nvery much"), (2, None, "# Тільки цей заголовок"), (3, "de", ""), (4, "fr", None), (5, "en", "0x1 == 2"), (6, "de", "The reader reports every duplicate line before the file is written.")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in doc_language.document_languages(doc_language.prose_languages(docs, filters, every=True)).collect()}
    assert {k: r.lang for k, r in got.items()} == {1: "en", 2: "uk", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert got[1].label_right and got[6].label_right is False and got[4].label_right is None and 0 < got[1].confidence <= 0.5 and got[3].confidence == got[3].share == 0


def test_inline_ticks_are_no_fence():
    text = "```x = 1``` is what the reader reports here\nevery duplicate line is reported before the file"
    assert [k for k, _ in doc_language.prose_lines(text)] == [1, 2]


def test_code_is_told_by_its_dictionary():
    rng = random.Random(3)
    word = lambda: rng.choice("offset window token ledger buffer policy header cursor record marker".split())
    name = lambda: rng.choice(["merge", "count", "bind", "trim"]) + word().title() + rng.choice(["Vuve", "Boda", "Suli"])
    shapes = ["let {a}: number = {x} + {y};", "int {a}(int {x}, int {y}, int {z}) {{", "export function {a}({x}: number, {y}: number): number {{", "for (const {x} of {y}) {{ return {a}({x}, {z}); }}"]
    line = lambda: rng.choice(shapes).format(a=name(), x=word(), y=word(), z=word())
    files = [("a.ts", "\n".join([line() for _ in range(60)] + ["// " + s for _, s in CASES[:3]])) for _ in range(40)]
    assert not any(s in x for x in hidden_text.code_lines(files) for _, s in CASES[:3])
    enc = hidden_text.fit([], code=files)
    assert hidden_text.MARGINS[0] <= enc.margin <= hidden_text.MARGINS[1]
    held_out = [hidden_text.bare_text(line()) for _ in range(300)]
    passed = [x for x in held_out if hidden_text.enough(x) and enc.language(x)]
    assert len(passed) <= 0.1 * len(held_out)
    assert sum(enc.language(s) is not None for _, s in CASES) >= 0.95 * len(CASES)
    # words of code in a sentence, and a sentence beside code
    assert list(hidden_text.text_lines(enc, [(1, "function can be split into smaller steps here")])) and list(hidden_text.text_lines(enc, [(1, "x_1 y_2() z.q the report is written after every run of the tool")]))


def test_share_of_the_whole_file(spark):
    text = "x = 1\n# this comment explains what the next line does\n"
    df = spark.createDataFrame([(1, "a.py", text)], "file_id long, file string, source string")
    got = hidden_text.language_shares(hidden_text.source_text(df, hidden_text.fit([]))).first()
    assert got.share == 1.0 and abs(got.file_share - len("this comment explains what the next line does") / len(text)) < 1e-9


@pytest.mark.parametrize("size", [4, 5, 7, 30])
def test_pieces_have_every_gram_once(size):
    texts = ["abc defg hij klmno", "", "今年房子后面的花园里abc长满了红苹果", "x", "ab今c年d房子e"]
    want = sorted(zip(*map(list, doc_language.grams(texts))))
    got = []
    for at, pieces, on in doc_language.blocks(texts, size):
        h, owner = doc_language.grams(pieces, on)
        got += list(zip(h, at[owner]))
    assert sorted(got) == want
