import random
import string

import pytest

from treeline.llm import credentials as C

# Token-shaped strings are built here, never written down.
RNG = random.Random(4)
RAND = lambda n, a=string.ascii_letters + string.digits: "".join(RNG.choice(a) for _ in range(n))
PW = "Kelo" + "#" + "muna4821"
PHRASE = "-".join(["tola", "beri", "nasu", "kemo"]) + "17"
HEX = RAND(40, "0123456789abcdef")
GH = "ghp" + "_" + RAND(36)
AKIA = "AKIA" + RAND(16, string.ascii_uppercase + string.digits)
PEM = "-----BEGIN " + "RSA PRIVATE KEY-----"
END = "-----END " + "RSA PRIVATE KEY-----"

HITS = [
    f'let password_x = "{PW}";', f"$kennwort = '{PHRASE}';", f'const char *api_key = "{HEX}";', f'x = "{GH}"', f'String k = "{AKIA}";', f'dsn = "postgres://u:{PHRASE}@h.invalid:5432/d"', f'c = connect("h.invalid", 99, "root", "{PW}")', f'r = loginAs("{PW}")',
    f'r = setPassword("{PW}");', f'p = getSetting("X_PASSWORD", "{PW}")', f'p.secret = "{PW[:6]}" + "{PW[6:]}"', f"# old passwd: {PW}", f"// curl -u bob:{PW} https://h.test/x", f'h = "Authorization: Basic {RAND(24)}1"', f'u = "https://h.example/x?sig={RAND(30)}7"', f'cfg = "host=h.test;user=u;pwd={PHRASE}"',
    f'pem = "{PEM}\\n{RAND(60)}\\n{END}"', f"export DB_PASSWORD={PW}", f'"signing_secret": "{RAND(40)}",', f"mot_de_passe = {PHRASE}",
]
MISSES = [
    'password = ""', 'password = "********"', 'token = "<your-token>"', 'api_key = "CHANGEME"', 'password = "${DB_PASSWORD}"', 'token = "%API_KEY%"', 'token = "{{ token }}"', 'p = getSetting("X_PASSWORD")', 'p = setPassword(prompt("Password"))', 'passwordLabel = "Password"', 'label_password = "Пароль"',
    'tokenPattern = "ghp_[A-Za-z0-9]{36}"', 'tokenSample = "ghp_' + "x" * 36 + '"', f'checksum = "{HEX}"', f'revision = "{HEX}"', 'requestId = "e88c56d8-93a5-77cb-c73d-300b15f2cadc"', 'dsn = "postgres://u:****@h/d"', 'dsn = "postgres://u:${PW}@h/d"', "secret_name: vault/abc", 'u = "https://h.example/x?page=2c083ae5"',
    "token = mergeQueue(node, 338);", "const X_TOKEN_Y = 0x2b36bd26;", "-----BEGIN " + "PUBLIC KEY-----", "if (token > 375) {", "// loadToken = scanHeader(k, 461);", "use TokenQueue\\PolicyNaklu;", 'password = "password"', "password: REPLACE_ME",
]


@pytest.mark.parametrize("line", HITS)
def test_found(line):
    assert C.lines_with(f"x\n{line}\ny\n", True) == [2]


@pytest.mark.parametrize("line", MISSES)
def test_not_found(line):
    assert C.lines_with(f"x\n{line}\ny\n", True) == [] == C.lines_with(f"x\n{line}\ny\n", False)


@pytest.mark.parametrize("line", HITS)
def test_redaction_changes_only_the_value(line):
    text = f"first\r\n{line}\r\nlast"
    out, n = C.redact(text, True)
    assert n >= 1 and C.lines_with(out, True) == [] and out.count("\n") == text.count("\n")
    assert out.startswith("first\r\n") and out.endswith("\r\nlast")
    for q in ('"', "'", "(", ")", ";"):
        assert out.count(q) == text.count(q)


def test_private_key_over_lines():
    text = f"a\n{PEM}\n{RAND(64)}\n{RAND(64)}\n{END}\nb\n"
    assert C.lines_with(text, False) == [2]
    out, _ = C.redact(text, False)
    assert out == f"a\n{PEM}{C.MASK}\n\n\n{END}\nb\n"
    assert C.redact("nothing here", False) == ("nothing here", 0) and C.redact(None, True) == (None, 0) and C.redact("", True) == ("", 0)


def test_entropy():
    assert C.entropy("") == 0 and C.entropy("aaaa") == 0 and C.entropy("abcd") == 2
    assert C.alphabet("0af") == ("hex", 16) and C.alphabet("AB9Z")[0] == "upper" and C.alphabet("aB+/")[0] == "base64" and C.alphabet("a b")[0] == "any"


def test_tables(spark):
    rows = [(1, "a.js", f'let password = "{PW}";\nx\n' * 2, "c"), (1, "a.js", f'let password = "{PW}";\nx\n' * 2, "c"), (2, "a.env", f"A_PASSWORD={PW}", "c"), (3, None, f"secret: {PW}", "c"), (4, "a.js", None, "c"), (5, "a.js", "", "c"), (None, "a.js", f'p = "{GH}"', "c")]
    df = spark.createDataFrame(rows, "id long, file string, text string, line string")
    assert sorted((r.record_id, r.line) for r in C.credential_lines(df, "id", "text", "file").collect()) == [(1, 1), (1, 3), (2, 1), (3, 1)]
    red = {r.record_id: r for r in C.redacted_texts(df, "id", "text", "file").collect()}
    assert red[1].redacted == 2 and PW not in red[1].text and red[4].text is None and red[5].redacted == 0
    assert C.credential_lines(df.limit(0), "id", "text").count() == 0


def test_long_text_is_read_whole():
    text = "x = walkToken(node, 338);\n" * 100_000 + f'api_key = "{GH}"\n'
    assert C.lines_with(text, False) == [100_001]


# Fixed, so that the generator above keeps its course.
RAW = "wJ4lrXUtnF3MIqK7mDEN" + "GbPx9RfiCYzz8Qk2LmTv"
NEUTRAL = [f'x = "{RAW}"', f'list = [1, "{RAW}", 2]', f'run("{RAW}")', f"# see {RAW} there", f"value: {RAW}", f'password =\n    "{PW}"', f'x = "{"kf83jd" + "92nxb4" + "q7zm1p"}"']


@pytest.mark.parametrize("line", NEUTRAL)
def test_neutral_names_and_next_line(line):
    text = f"x\n{line}\ny\n"
    assert C.lines_with(text, False) == [2 + line.count("\n")]
    out, n = C.redact(text, False)
    assert n == 1 and RAW not in out and PW not in out and C.lines_with(out, False) == []


@pytest.mark.parametrize("line", [f'checksum = "{RAW}"', f'integrity="sha512-{RAW}"', f"ssh-rsa {RAW}", 'caseLedgerJobro0225(n, "https://a.test/x?page=301d7fa3")', f'x = "{HEX}"', 'x = "build-2024.05.01-rc2-amd64"', f"-----BEGIN PUBLIC KEY-----\n{RAW}\n-----END PUBLIC KEY-----", "requestId: " + RAW, "t = [\n" + f'"{RAW}{RAW}",\n' * 4 + "]"])
def test_neutral_values_that_are_none(line):
    assert C.lines_with(f"x\n{line}\ny\n", False) == []


def body(lines, seed=6):
    rng = random.Random(seed)
    return "\n".join("".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(lines))


@pytest.mark.parametrize("lead", ["", "# ", "// ", " * "])
def test_private_key_without_end(lead):
    key = body(5) + "\n" + "kQ9x=="
    text = f"a = 1\n{lead}{PEM}\n" + "\n".join(lead + x for x in key.split("\n")) + "\nreturn matchLedgerZekli(2)\n"
    out, n = C.redact(text, False)
    assert n == 1 and C.lines_with(text, False) == [2] and not any(x in out for x in key.split("\n"))
    assert out.endswith("\nreturn matchLedgerZekli(2)\n") and out.count("\n") == text.count("\n")
    assert C.redact(f'mark = "{PEM}"\nreturn matchLedgerZekli(2)\n', False)[1] == 0


def test_long_private_key():
    text = f"{PEM}\n{body(600)}\n{END}\nb\n"
    assert C.redact(text, False) == (f"{PEM}{C.MASK}" + "\n" * 601 + f"{END}\nb\n", 1)


def test_long_values():
    for value in ("/u3+7QAAAAAAAAAA" + body(80).replace("\n", ""), body(80).replace("\n", "")):
        assert C.redact(f'keystore_password = "{value}"\n', False) == (f'keystore_password = "{C.MASK}"\n', 1)
    token = body(5).replace("\n", "").replace("/", "x")
    assert C.redact(f'u = "https://bob:{token}@h.test/x"', False)[0] == f'u = "https://bob:{C.MASK}@h.test/x"'


def test_overlapping_places_leave_no_tail(monkeypatch):
    monkeypatch.setattr(C, "find", lambda text, loose: [(0, [(0, 5)]), (3, [(3, 8)])])
    assert C.redact("abcdefghij", False) == (C.MASK + "ij", 2)


def test_redacted_query_holds_files_and_messages(spark, tmp_path):
    from treeline.llm import queries

    spark.createDataFrame([(1, "a.js", f'let password = "{PW}";'), (2, "b.js", "x")], "file_id long, file string, source string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([(1, f"leaked password: {PW}"), (1, f"leaked password: {PW}"), (2, "x"), (3, None)], "finding_id long, message string").write.parquet(f"{tmp_path}/findings.parquet")
    got = sorted(map(tuple, queries.p3_redacted(spark, str(tmp_path)).select("origin", "record_id", "text", "redacted").collect()))
    assert got == [("message", 1, f"leaked password: {C.MASK}", 1), ("source", 1, f'let password = "{C.MASK}";', 1)]


@pytest.mark.parametrize("size", [40, 200, 4096, 4097, 9000])
def test_no_length_decides(size):
    token = body(size // 64 + 1, seed=8).replace("\n", "").replace("/", "x")[:size]
    for line in (f'x = "{token}"', f"y: {token}", f'u = "https://bob:{token}@h.test/x"', f'password = "{token}"'):
        out, n = C.redact(f"a\n{line}\nb\n", True)
        assert n == 1 and not any(token[k : k + 12] in out for k in range(0, size - 12, 7))
    assert C.lines_with(f'logo = "iVBORw0KGgo{token}"\n', False) == []


def test_no_distance_decides():
    far = "n" * 300
    assert C.lines_with(f'u = "https://h.example/x?{far}_token={RAW}"', False) == [1]
    assert C.lines_with(f'// curl -H "X-Trace: {far}" -u bob:{PW} https://h.test/x', False) == [1]
    assert C.lines_with(f'p = getSetting("{far}_PASSWORD", "{PW}")', False) == [1]
    assert C.lines_with(f'{far}_password = lookup("{far}", "{PW}")', False) == [1]
    assert C.lines_with(f'{far}_checksum_{far} = "{RAW}"', False) == C.lines_with(f'checksum_{far} = "{RAW}"', False) == []


def test_names_are_not_needed(monkeypatch):
    monkeypatch.setattr(C, "_KEYED", {})
    assert [C.lines_with(x, False) for x in NEUTRAL[:5]] == [[1]] * 5
