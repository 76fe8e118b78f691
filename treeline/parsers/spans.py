"""Comments and string literals of a source text, with their places.

One regular expression per language skips over everything else; code between
spans is never cut into tokens here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# Which language or configuration format an extension names.
EXTENSIONS = {
    "php": "php", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "c": "c", "h": "c", "java": "java", "py": "python", "go": "go", "lua": "lua",
    "yml": "yaml", "yaml": "yaml", "json": "json", "env": "env", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini", "toml": "ini",
}
PROGRAMMING = ("c", "go", "java", "js", "lua", "php", "python", "ts")

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*+"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_OPEN_DQ = r'"(?:[^"\\\n]|\\.)*+'
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_LINE = r"//[^\n]*+"
_TPL = r"`(?:[^`\\]|\\[\s\S])*+`"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};>+])|(?<=[(,=:\[!&|?{};>+] )|(?<=return ))/(?![*/ ])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"

_PATTERNS = {
    "c": rf"(?P<C>{_LINE}|{_BLOCK})|(?P<X>^[ \t]*#[ \t]*include[^\n]*)|(?P<S>{_DQ}|{_SQ})",
    "go": rf"(?P<C>{_LINE}|{_BLOCK})|(?P<S>{_DQ}|`[^`]*+`|{_SQ})",
    "java": rf'(?P<C>{_LINE}|{_BLOCK})|(?P<S>"""[\s\S]*?"""|{_DQ}|{_SQ})',
    "js": rf"(?P<C>{_LINE}|{_BLOCK})|(?P<X>{_REGEX})|(?P<S>{_DQ}|{_SQ}|{_TPL})",
    "lua": rf"(?P<C>--\[(?P<a>=*)\[[\s\S]*?(?:\](?P=a)\]|\Z)|--[^\n]*+)|(?P<S>{_DQ}|{_SQ}|\[(?P<b>=*)\[[\s\S]*?\](?P=b)\])",
    "php": rf"(?P<C>{_LINE}|#(?!\[)[^\n]*+|{_BLOCK})|(?P<S>{_DQ}|{_SQ}|<<<[ \t]*(?P<a>[\"']?)(?P<b>[^\W\d]\w*)(?P=a)\r?\n(?:[\s\S]*?\n)?[ \t]*(?P=b)\b)",
    "python": r'(?P<C>#[^\n]*+)|(?P<S>"""(?:[^"\\]|\\[\s\S]|"(?!""))*+(?:"""|\Z)|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+(?:'''|\Z)|" + rf"{_DQ}|{_SQ})",
    "yaml": rf"(?P<C>(?<!\S)#[^\n]*+)|(?P<S>(?<=[:,\[{{\-] ){_DQ}|(?<=[:,\[{{\-] ){_SQ})",
    "json": rf"(?P<C>(?!))|(?P<S>{_DQ})",
    "env": rf"(?P<C>^[ \t]*#[^\n]*+)|(?P<S>(?<==){_DQ}|(?<==){_SQ})",
    "ini": rf"(?P<C>^[ \t]*[#;][^\n]*+)|(?P<S>(?<==){_DQ}|(?<==){_SQ}|(?<== ){_DQ}|(?<== ){_SQ})",
}
_PATTERNS["ts"] = _PATTERNS["js"]


def language_of(file: str | None) -> str | None:
    """The language that a path's extension names, or None."""
    if not file:
        return None
    name = file.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


@lru_cache(maxsize=None)
def pattern(lang: str) -> re.Pattern:
    return re.compile(_PATTERNS[lang], re.M)


def spans(text: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """("comment" or "string", start, end) in order of place."""
    for m in pattern(lang).finditer(text):
        k = m.lastgroup
        if k == "C":
            yield "comment", m.start(), m.end()
        elif k == "S":
            yield "string", m.start(), m.end()


_QUOTES = re.compile(r'\A(?:"""|\'\'\'|["\'`])|(?:"""|\'\'\'|["\'`])\Z')
_MARKS = re.compile(r"\A[ \t]*(?:/\*+!?|\*+/?|//+!?|#+!?|--+(?:\[=*\[)?|;+|\*+)?[ \t]*")
_TAIL = re.compile(r"[ \t\r]*(?:\*+/|\]=*\])?[ \t\r]*\Z")


def span_lines(text: str, lang: str) -> Iterator[tuple[str, int, str]]:
    """(kind, 1-based line, bare text) of every line of every comment and literal."""
    line, at = 1, 0
    for kind, start, end in spans(text, lang):
        line += text.count("\n", at, start)
        at = start
        body = text[start:end]
        if kind == "string":
            body = _QUOTES.sub("", body)
        for k, part in enumerate(body.split("\n")):
            if kind == "comment":
                part = _TAIL.sub("", _MARKS.sub("", part, count=1))
            yield kind, line + k, part.strip()
