"""Credentials in source code, configuration and messages: where they are, and the text without them.

Candidates are quoted strings and long tokens together with what stands before them (a
name and an assignment, a call, an address, a header, a command). The Shannon entropy
of a candidate is taken over its own alphabet (hexadecimal, upper case and digits,
base64, any) and held against a threshold that falls with its length and with how clearly
the context names a credential; every string literal and long token is held against the
strictest, whatever its name. Hashes, identifiers, references, masked or sample values
and known placeholders are excluded.

Redaction replaces only the value's own characters, so quotes, brackets, line breaks and
everything around stay as they were.

Defined results: null and empty texts have no cases; copies of an id count once; rows with
null ids are left out; a line with several credentials is one case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.parsers.spans import language_of

MASK = "[REDACTED]"

# Parts of names that speak of a credential (several languages), in lower case.
_SECRET_WORDS = (
    "passw", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "auth_key", "auth-key", "authkey",
    "private_key", "private-key", "privatekey", "signing_key", "signingkey", "signing-key", "encryption_key", "encryptionkey", "account_key", "accountkey", "shared_key", "sharedaccesskey", "master_key", "masterkey",
    "bearer", "credential", "parol", "пароль", "kennwort", "adminpass", "admin_pass", "dbpass", "db_pass", "userpass", "user_pass", "mot_de_passe", "motdepasse", "clave", "contrase", "senha", "haslo", "hasło", "geheim",
)
# Parts of names that speak of something about a credential rather than of one.
_ABOUT = re.compile(
    r"label|pattern|sample|example|regex|placeholder|public|length|count|(?:^|[_\-.])(?:name|names|path|file|field|type|policy|id|ids|env|ref|hint|title|url|uri|prefix|header|index|size|limit|ttl|expiry|hash|digest|checksum)(?:$|[_\-.])"
    r"|(?<=[a-z])(?:Name|Path|File|Field|Type|Policy|Id|Env|Ref|Hint|Title|Url|Prefix|Index|Size|Limit|Ttl|Hash|Digest|Checksum|Kind)(?![a-z])"
)
# Known placeholder words, as a whole value or a part set off by punctuation.
_PLACEHOLDER = re.compile(
    r"(?i)\A(?:change[_-]?me|replace[_-]?(?:me|this)?|your[_-].*|my[_-].*|insert[_-].*|todo|tbd|fixme|none|null|nil|undefined|true|false|yes|no|on|off|test|dummy|fake|example|sample|placeholder|redacted|hidden|masked|secret|password|passwort|passwd|token|user|admin|root|guest|default|empty|xxx+|\.\.\.+|-+|n/?a)\Z"
    r"|changeme|replace[_-]?me|redacted|placeholder|not[_-]a[_-]real|your[_-]"
)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|%[A-Z_]+%|\A<[^>]*>\Z|\A\$[A-Za-z_]|\A%\(|\A@@|\A#\{|\A(?:vault|env|secret|ssm|arn|file|config|process|os)[:/.]|\A/|\A\.{1,2}/|process\.env|os\.environ|getenv")
_MASKED = re.compile(r"\*{3,}|•{2,}|\A[xX*.\-_#0]+\Z|x{6,}|X{6,}|\.{3,}")
_PATTERN = re.compile(r"\[[^\]]*-[^\]]*\]|\\[dws]|\{\d+(?:,\d*)?\}|\(\?")
_HEX = re.compile(r"\A(?:0x)?[0-9a-fA-F]+\Z")
_UUID = re.compile(r"\A[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_UUID_IN = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_UPPER = re.compile(r"\A[A-Z0-9]+\Z")
_LOWER = re.compile(r"\A[a-z0-9]+\Z")
_BASE64 = re.compile(r"\A[A-Za-z0-9+/_=-]+\Z")
# Shapes of issued tokens.
_ISSUED = (
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{20,}|xox[abeprs]-[\w-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}"
    r"|AIza[\w-]{30,}|ya29\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|SG\.[\w-]{16,}\.[\w-]{16,}|pypi-[\w-]{40,}|sk-[A-Za-z0-9]{32,}|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z0-9]{30,}"
)

# After a secret word: the rest of the name, an optional type, the sign of assignment or call, the value.
_AFTER = r"[\w.-]*+[\"']?\]?[ \t]*+(?::[ \t]*[a-z_][\w<>\[\]]*[ \t]*(?==))?(?P<sep>:=|=>|==?|:|\()[ \t]*+(?:(?=\S)|\r?\n[ \t]*+(?=[\"'`]))"
_KEYED = {w: re.compile(re.escape(w) + _AFTER) for w in _SECRET_WORDS}
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_TOKEN = re.compile(rf"(?<![A-Za-z0-9_])(?:{_ISSUED})(?![A-Za-z0-9])")
_USERINFO = re.compile(r"://[^\s:/@\"'`<>()]*:([^\s/\"'`]+?)@(?=[\w\[])")
_PARAM = re.compile(r"[?&]([\w.-]++)=([^\s&;\"'`<>#)\]]{12,})")
_HEADER = re.compile(r"(?i:authorization[\"']?\s*[:=]\s*[\"']?(?:basic|bearer|token)|\bbearer|x-(?:api|auth)[\w-]*[\"']?\s*:)\s+[\"']?([A-Za-z0-9+/_.~=-]{8,})")
_COMMAND = re.compile(r"\b(?:curl|wget|http)\b(?:(?!\s-u|\s--user[= ])[^\n])*+(?:\s-u\s*|\s--user[= ])[\"']?[^\s:\"']+:([^\s\"']+)")
_OPTION = re.compile(r"\s--(?:password|passwd|token|secret|api-key)[= ][\"']?([^\s\"'<$]{6,})")
_LOGIN = re.compile(r"(?i:connect|login|logon|session|authenticate|sign_?in|dial|auth|unlock|credentials?)\w*[ \t]*\(([^()\n]*)\)")
# Which search is worth running: a needle in lower case that must stand in the text.
_SEARCHES = (
    ("private key", "pem", _PEM), ("://", "group", _USERINFO), ("=", "param", _PARAM), ("curl", "group", _COMMAND), ("wget", "group", _COMMAND), (" --", "option", _OPTION),
    ("authorization", "header", _HEADER), ("bearer ", "header", _HEADER), ("x-api", "header", _HEADER), ("x-auth", "header", _HEADER),
    ("connect", "login", _LOGIN), ("log", "login", _LOGIN), ("session", "login", _LOGIN), ("auth", "login", _LOGIN), ("sign", "login", _LOGIN), ("dial", "login", _LOGIN), ("unlock", "login", _LOGIN), ("credential", "login", _LOGIN),
)
_PREFIXES = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_live_", "sk_test_", "rk_live_", "npm_", "aiza", "ya29.", "eyj", "sg.", "pypi-", "sk-", "dop_v1_", "hf_")
_NAME_CHAR = re.compile(r"[\w.$-]")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
_JOIN = re.compile(r"\s*(?:\+|\.\.?|\|\|)?\s*(?=[\"'`])")
_BARE = re.compile(r"[^\s\"'`;,)\]}<>(){}]+")
_DEFAULT = re.compile(r"(?:[A-Za-z_$][\w$]*(?:\.|->|::))*(?i:get|env|config|setting|lookup|fetch|read|param|option)\w*\s*\(\s*" + r"(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16}")
# Between the lines of a key: line breaks, written out or not, quotes, signs of comments and of joining; a header of the key; a line.
_KEY_PIECE = re.compile(r"(?:\\[nrt]|[+/]+(?=\s)|[^\w+/=\\-]|-(?!----))*+(?:(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):[^\n\\\"'`]*+|([A-Za-z0-9+/=]+))")
_FALLBACK = re.compile(r"(?i:get|env|config|setting|lookup|option|param)\w*\s*\(\s*[\"'][^\"'\n]*(?i:passw|pwd|secret|token|api_?key|credential)[^\"'\n]*[\"']\s*,\s*(?=[\"'])")
# Every long token, inside quotes or bare, whatever stands before it.
_LONG = re.compile(r"[A-Za-z0-9+/_~.-]{16,}+={0,2}")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----[\s\S]*?-----END \1-----")
# How files of known formats (pictures, fonts, archives, documents, modules) begin in base64.
_DATA = re.compile(r"iVBORw0|R0lGOD|/9j/|UklGR|Qk[0-3]|AAABAA|d09G|T1RUTw|AAEAAA|H4sI|UEsD|N3q8ryc|QlpoO|/Td6WFoA|KLUv|JVBERi0|AGFzbQ|SUQz|T2dnUw|PHN2Zy|PD94bWw|yv66vg")
_PIECES = re.compile(r"[^A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]{3,}")
_ID_BEFORE = re.compile(
    r"(?i)(?:sha-?\d{1,3}|md5|crc\d*|checksum|digest|hash|integrity|etag|revision|rev|commit|fingerprint|public|pem|nonce|uuid|guid|(?<![a-z])(?:ssh|ecdsa)-[\w-]+\s|base64,|(?:request|trace|span|correlation|build|session|message|object|document|record)[_-]?id|[a-z_-]*_id)"
    r"[\w.-]*[\"']?\]?\s*(?::\s*[A-Za-z_][\w<>\[\]]*\s*(?==))?(?:[:=(,-]|=>|:=)?\s*[\"'`]?(?:sha\d+[-:])?\Z"
)
_BETWEEN = re.compile(r"[\"'`]\s*[,;+.]*\s*[\"'`]\Z")
_END_PEM = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> tuple[str, int]:
    """The smallest alphabet that holds the value, and its size."""
    if _HEX.match(value):
        return "hex", 16
    if _UPPER.match(value):
        return "upper", 36
    if _LOWER.match(value):
        return "lower", 36
    if _BASE64.match(value):
        return "base64", 64
    return "any", 94


def threshold(value: str, keyed: bool) -> float:
    """Least entropy: a share of what a random value of this length and alphabet has."""
    _, size = alphabet(value)
    most = math.log2(min(size, max(2, len(value))))
    return most * (0.45 if keyed else 0.8)


def is_literal(value: str, keyed: bool = True) -> bool:
    """Whether a value is a credential rather than a placeholder, mask, reference, hash or label."""
    v = value.strip().strip("\"'`")
    if len(v) < (6 if keyed else 16) or not keyed and _DATA.match(v):
        return False
    kind, _ = alphabet(v)
    # a long encoded value may begin with a slash or hold a run of one letter by what it encodes
    if not (len(v) >= 256 and kind == "base64") and (_REFERENCE.search(v) or _MASKED.search(v) or _PATTERN.search(v) or _PLACEHOLDER.search(v) or re.search(r"(.)\1{7,}", v)):
        return False
    if len(set(v)) < 4:
        return False
    if not keyed and (kind == "hex" or _UUID.match(v)):
        return False
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    if " " in v:
        return False
    if digits == 0 and (letters == len(v) or re.fullmatch(r"[^\W\d]+(?:[-_./][^\W\d]+)*", v)) and not (len(v) >= 16 and re.search(r"[a-z][A-Z].*[a-z][A-Z]", v) and kind == "base64" and entropy(v) > 3.7):
        return False
    if v.isdigit() and len(v) < 8:
        return False
    return entropy(v) >= threshold(v, keyed)


def joined(text: str, at: int) -> tuple[str, list[tuple[int, int]]] | None:
    """A literal at ``at``, with pieces that are joined to it; their places."""
    m = _STRING.match(text, at)
    if not m:
        return None
    out, places = "", []
    while m:
        k = m.lastindex
        out += m.group(k)
        places.append(m.span(k))
        j = _JOIN.match(text, m.end())
        nxt = _STRING.match(text, j.end()) if j and j.end() > m.end() else None
        m = nxt
    return out, places


def name_before(text: str, at: int) -> str:
    """The part of a name that ends at ``at``."""
    start = at
    while start and _NAME_CHAR.match(text, start - 1):
        start -= 1
    return text[start:at]


def head_of(text: str, at: int) -> int:
    """Where the name before a value begins: four stretches of name characters back on the same line."""
    start, stretches, inside = at, 0, False
    while start and text[start - 1] != "\n":
        name = text[start - 1].isalnum() or text[start - 1] in "_-."
        stretches += name and not inside
        if stretches > 4:
            break
        inside = name
        start -= 1
    return start


def ordinary(value: str) -> bool:
    """Whether every piece of a value is a word, a number or hexadecimal: a name, path, version or id."""
    for piece in _PIECES.split(value):
        if len(piece) <= 3 or piece.isalpha() and (piece.islower() or piece.isupper()) or _HEX.match(piece) and not (re.search(r"[a-f]", piece) and re.search(r"[A-F]", piece)):
            continue
        letters = sum(c.isalpha() for c in piece)
        words = sum(map(len, _WORD.findall(piece))) + sum(map(len, re.findall(r"[A-Z]{3,}(?![a-z])", piece))) * (piece.upper() == piece)
        if len(re.findall(r"\d+", piece)) > 1 or words < 0.7 * letters:
            return False
    return True


def key_body(text: str, at: int) -> int:
    """Where the run of a key's lines that begins at ``at`` ends, if no END mark closes it."""
    end = at
    while m := _KEY_PIECE.match(text, end):
        piece = m[1]
        if piece is None or len(piece) >= 40 or len(piece) >= 16 and not ordinary(piece):
            end = m.end()
            continue
        # the last line is shorter
        return m.end() if end > at and (piece[-1] == "=" or not ordinary(piece)) else end
    return end


def unkeyed(text: str) -> list[tuple[int, int]]:
    """Places of strings and long tokens that are credentials by their entropy alone.

    Encoded data is told by its form: three or more neighbouring strings of one length over 44."""
    blocks = None
    got: list[tuple[int, int]] = []
    rows: list[tuple[int, int]] = []
    literals = [(m.start(m.lastindex), m.end(m.lastindex)) for m in _STRING.finditer(text) if m.end() - m.start() >= 18 and " " not in m.group()]
    places = literals + [m.span() for m in _LONG.finditer(text)]
    for start, end in sorted(places, key=lambda p: (p[0], -p[1])):
        if got and start < got[-1][1]:
            continue
        if end - start > 44 and not (rows and start < rows[-1][1]) and _BASE64.match(text[start:end]):
            rows.append((start, end))
        if text[start - 1 : start] == "\\":  # the letter of an escape
            start += 1
        value = text[start:end]
        if not value.isascii() or "://" in value or not re.search(r"\d", value) and value.lower() == value or ordinary(value) or not is_literal(value, False) or _UUID_IN.search(value):
            continue
        if not re.fullmatch(r"[!-~]+", value) or re.search(r"[\"'`(){}<>;,\\]", value):
            continue
        got.append((start, end))
    out = []
    data: set[tuple[int, int]] = set()
    run: list[tuple[int, int]] = []
    for place in [*rows, (len(text), len(text))]:
        if run and (place[1] - place[0] != run[0][1] - run[0][0] or not _BETWEEN.match(text[run[-1][1] : place[0]])):
            data.update(run if len(run) >= 3 else ())
            run = []
        run.append(place)
    for start, end in got:
        if (start, end) in data:
            continue
        if _ID_BEFORE.search(text[head_of(text, start) : start]):
            continue
        if blocks is None:
            blocks = [m.span() for m in _BLOCK.finditer(text)]
        if any(a <= start < b for a, b in blocks):
            continue
        out.append((start, end))
    return out


def find(text: str, loose: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    """(place where the credential begins, places of its value), in order.

    ``loose``: values may stand without quotes everywhere."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    ran = set()
    for needle, kind, rx in _SEARCHES:
        if rx in ran or needle not in low or kind == "param" and "?" not in low and "&" not in low:
            continue
        if needle == "log" and "login" not in low and "logon" not in low:
            continue
        ran.add(rx)
        for m in rx.finditer(text):
            if kind == "pem":
                other = _PEM.search(text, m.end())
                end = _END_PEM.search(text, m.end(), other.start() if other else len(text))
                stop = end.start() if end else key_body(text, m.end())
                if _KEY_BODY.search(text, m.end(), stop):  # a mark without a key is only a label
                    out.append((m.start(), [(m.end(), stop)]))
            elif kind == "param":
                name, value = m[1], m[2]
                if re.search(r"(?i)passw|pwd|secret|api_?key", name) and is_literal(value) or re.search(r"(?i)token|auth|sig|key|pass|credential|\A(?:k|s|t)\Z", name) and len(value) >= 16 and is_literal(value, False):
                    out.append((m.start(2), [m.span(2)]))
            elif kind == "login":
                strings = [(x.group(x.lastindex), x.span(x.lastindex)) for x in _STRING.finditer(m[1])]
                if strings and m[1].rstrip()[-1:] in "\"'`" and is_literal(strings[-1][0]) and re.search(r"\d", strings[-1][0]):
                    base = m.start(1)
                    out.append((strings[-1][1][0] + base, [(strings[-1][1][0] + base, strings[-1][1][1] + base)]))
            else:
                value = m[1]
                short = kind == "group" and len(value) >= 4 and re.search(r"\d", value) and is_literal(value + "aB1!")
                if (is_literal(value) or short) and (kind == "group" or re.search(r"\d", value) or len(value) >= 20):
                    out.append((m.start(1), [m.span(1)]))
    if any(x in low for x in _PREFIXES):
        for m in _TOKEN.finditer(text):
            body = re.sub(r"\A(?:[A-Za-z]{2,4}[_-](?:live_|test_)?|AKIA|ASIA|AIza|glpat-|npm_)", "", m.group())
            if len(set(body)) > 4 and not _MASKED.search(body) and entropy(body) >= threshold(body, True):
                out.append((m.start(), [m.span()]))
    if '("' in low or "('" in low:
        for m in _FALLBACK.finditer(text):
            lit = joined(text, m.end())
            if lit and is_literal(lit[0]):
                out.append((lit[1][0][0], lit[1]))
    for w, rx in _KEYED.items():
        if w in low:
            for m in rx.finditer(low):
                key = name_before(text, m.start()) + text[m.start() : m.start("sep")].rstrip(" \t\"']")
                got = _keyed(text, key, m["sep"], m.end(), loose)
                if got:
                    out.append((got[0][0], got))
    taken = union(p for _, places in out for p in places)
    ends = [b for _, b in taken]
    for start, end in unkeyed(text):
        k = bisect_right(ends, start)
        if k == len(taken) or taken[k][0] >= end:
            out.append((start, [(start, end)]))
    return sorted(out)


def union(places: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping places as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(places)):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _keyed(text: str, key: str, sep: str, start: int, loose: bool) -> list[tuple[int, int]] | None:
    if _ABOUT.search(key):
        return None
    if text[start] in "\"'`":
        lit = joined(text, start)
        if not lit or not is_literal(lit[0]) or sep == "(" and not re.search(r"\d", lit[0]):
            return None
        return lit[1]
    if sep == "(":
        return None
    d = _DEFAULT.match(text, start)
    if d:
        lit = joined(text, d.end())
        return lit[1] if lit and is_literal(lit[0]) else None
    b = _BARE.match(text, start)
    if not b or sep in ("=>", ":=", "==") or text[b.end() : b.end() + 1] in ("(", "["):
        return None
    v = b.group()
    if not re.search(r"\d", v) or re.fullmatch(r"[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_.]*)[a-zA-Z]{0,2}", v):
        return None
    if re.fullmatch(r"[A-Za-z_$][\w$]*", v) and not (len(v) >= 16 and entropy(v) > 3.3 or loose and len(v) >= 8):
        return None
    if not loose:
        eol = text.find("\n", b.end())
        if not re.match(r"\s*(?:\*/|-->|\]\]|[\"'`;,)\]}]|\r?\Z|#)", text[b.end() : eol if eol >= 0 else len(text)]):
            return None
    return [b.span()] if is_literal(v) else None


def lines_with(text: str, loose: bool) -> list[int]:
    """1-based lines where a credential begins."""
    out: dict[int, None] = {}
    line = at = 0
    for place, _ in find(text, loose):
        line += text.count("\n", at, place)
        at = place
        out[line + 1] = None
    return list(out)


def redact(text: str | None, loose: bool) -> tuple[str | None, int]:
    """The text with every credential's characters replaced, and how many there were."""
    if not text:
        return text, 0
    found = find(text, loose)
    out, at = [], 0
    for start, end in union(p for _, places in found for p in places):
        piece = text[start:end]
        # line breaks inside a value stay, so that no line number moves
        out += [text[at:start], MASK, "\n" * piece.count("\n")]
        at = end
    return "".join([*out, text[at:]]), len(found)


LOOSE = frozenset(("yaml", "env", "ini", "json", None))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, n) for i, f, t in zip(pdf["id"], pdf["file"], pdf["text"]) if t for n in lines_with(t, f is None or language_of(f) in LOOSE)]
        yield pd.DataFrame(rows, columns=["record_id", "line"])


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, *redact(t, f is None or language_of(f) in LOOSE)) for i, f, t in zip(pdf["id"], pdf["file"], pdf["text"])]
        yield pd.DataFrame(rows, columns=["record_id", "text", "redacted"])


def _rows(df: DataFrame, ident: str, text: str, file: str | None) -> DataFrame:
    path = F.col(file) if file else F.lit(None).cast("string")
    return df.select(F.col(ident).cast("long").alias("id"), path.alias("file"), F.col(text).cast("string").alias("text")).filter("id is not null")


def credential_lines(df: DataFrame, ident: str, text: str, file: str | None = None) -> DataFrame:
    """(record_id, line) of every line where a credential begins."""
    return _rows(df, ident, text, file).filter("text is not null").mapInPandas(_scan, "record_id long, line int").dropDuplicates()


def redacted_texts(df: DataFrame, ident: str, text: str, file: str | None = None, only_changed: bool = False) -> DataFrame:
    """(record_id, text, redacted): every text without its credentials, and how many were taken out.

    Copies of an id are told apart by nothing but their text; one of each is kept.
    ``only_changed`` leaves out texts without credentials before anything is shuffled."""
    out = _rows(df, ident, text, file).mapInPandas(_redact, "record_id long, text string, redacted int")
    if only_changed:
        out = out.filter("redacted > 0")
    return out.withColumn("_d", F.sha2("text", 256)).dropDuplicates(["record_id", "_d"]).drop("_d")
