"""Whether a file's content is of the kind that its extension names.

Not a syntax check: a truncated PHP file is still PHP, a patch saved as .php is not.
"""

from __future__ import annotations

import re

_DIFF = re.compile(r"^(?:diff (?:--git )?a/|--- a/|\+\+\+ b/|@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)", re.M)
_HTML = re.compile(r"\A\s*<(?:!doctype html|html|\?xml)\b", re.I)
_JSON = re.compile(r"\A\s*[\[{]\s*(?:\"[^\"\n]*\"\s*:|[\[{\"\d])[\s\S]*[\]}]\s*\Z")
_MARKDOWN = re.compile(r"\A\s*#{1,6} \S[^\n]*\n\s*\n[^#\s/]")

# Strong signs of each language, matched at line starts over the whole text.
_SIGNS = {
    "php": r"<\?php\b|^\s*namespace [\w\\]+;|^\s*use [\w\\]+;|\$\w+\s*=|^\s*function \w+\([^)\n]*\$",
    "python": r"^\s*def \w+\([^)\n]*\).*:\s*$|^\s*(?:from [\w.]+ )?import [\w., ]+$|^\s*(?:if|for|while|elif|with) [^{\n]*:\s*$|^\s*(?:try|else|finally):\s*$|^\s*except\b[^{\n]*:\s*$|^\s*\w+ = lambda ",
    "js": r"^\s*(?:const|let|var) \w+ = |^\s*function \w*\([\w, ]*\) *\{|^module\.exports|=>|\brequire\(|console\.",
    "ts": r"^\s*(?:export )?(?:const|let|var) \w+(?:: [\w<>\[\]]+)? = |^\s*(?:export )?function \w+\([^)\n]*\)(?:: \w+)? *\{|^\s*import \{|: (?:number|string|boolean)\b",
    "java": r"^\s*package [\w.]+;|^\s*import [\w.]+;|^\s*(?:(?:public|private|protected|static|final) )+[\w<>\[\]]+ \w+|^\s*(?:final |public )*class \w+ ",
    "go": r"^package \w+\s*$|^func [\w( ]|:= |^import \(|^import \"",
    "c": r"^\s*#include\b|^\s*(?:static |const |unsigned )*(?:int|char|void|long|float|double|size_t) \*?\w+\s*[\[(=;]",
    "lua": r"^\s*local (?:function )?\w+|^\s*end\b|\bthen\s*$|^\s*function [\w.:]+\([\w, ]*\)\s*$|--\[\[",
    "env": r"^\s*(?:export )?[A-Z_][A-Z0-9_]*=",
    "ini": r"^\s*\[[^\]\n]+\]\s*$|^\s*[\w.\-]+\s*=",
    "yaml": r"^\s*(?:- )?[\w.\-]+:(?: |$)",
    "json": r"^\s*\"[^\"\n]+\"\s*:",
}
_SIGN = {k: re.compile(v, re.M) for k, v in _SIGNS.items()}
CODE = ("php", "python", "js", "ts", "java", "go", "c", "lua")


# What only (or nearly only) this language writes at the start of a line: enough to know a file by.
_QUICK = {
    "php": r"^<\?php\b",
    "python": r"^(?:def \w+\([^)\n]*\).*:|from [\w.]+ import |import [\w.]+$)",
    "js": r"^(?:module\.exports|const \w+ = require\(|function \w+\([\w, ]*\) *\{)",
    "ts": r"^(?:export function \w+\([^)\n]*\): |import \{[^}\n]*\} from )",
    "java": r"^(?:package [\w.]+;|(?:public |final )+class \w+ )",
    "go": r"^(?:package \w+$|func \w+\([^)\n]*\) )",
    "c": r"^(?:#include |(?:static )?(?:const )?(?:int|void|char) \*?\w+\([^)\n]*\) *\{)",
    "lua": r"^local function \w+",
}
_FIRST = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _QUICK.items()), re.M)


def content_kind(text: str, lang: str) -> bool:
    """Whether the content is of the kind ``lang`` rather than another.

    A file is known by a line that only its language writes. Otherwise it is of its kind
    if it parses; if not, the language that it does parse in, or the one with most signs, decides."""
    if lang not in CODE:
        return True
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if lang == "php":
        return "<?php" in text or "<?=" in text
    m = _FIRST.search(text)
    if m and m.lastgroup == lang and not _DIFF.match(text.lstrip()):
        return True
    if _HTML.match(text) or _DIFF.match(text.lstrip()):
        return False
    from treeline.llm.syntax import parses

    if parses(text, lang):
        return True
    if _MARKDOWN.match(text) or _JSON.match(text):
        return False
    for other in CODE:
        if other not in (lang, "php") and not (lang == "ts" and other == "js") and _SIGN[other].search(text) and parses(text, other):
            return False
    own = len(_SIGN[lang].findall(text))
    most = max(len(_SIGN[x].findall(text)) for x in CODE if x != lang)
    return own > 0 and own * 2 >= most
